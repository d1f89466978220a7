"""Folders that hold the same or overlapping contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import cut

#: A content held by more folders than this opens no folder pair by itself; it still counts in pairs others open.
FAN_OUT = 25


def contents(files: DataFrame) -> DataFrame:
    """(folder, md5, n, size): each content of each folder and all folders above it, with its number of files."""
    rows = files.where("md5 IS NOT NULL AND scan_error IS NULL").select("md5", F.coalesce("size_bytes", F.lit(0)).alias("size"), F.explode(paths.ancestors("path")).alias("folder"))
    return rows.groupBy("folder", "md5").agg(F.count("*").alias("n"), F.max("size").alias("size"))


def folders(parts: DataFrame, min_files: int = 2) -> DataFrame:
    """(folder, signature, n_files, n_contents, bytes) of folders with at least min_files hashed files.

    The signature is order-free: sums of two independent 64-bit hashes over (content,
    count), so that no folder's contents are gathered in one place.
    """
    h1, h2 = F.xxhash64("md5", "n"), F.xxhash64(F.lit(1), "n", "md5")
    # sums in decimal never overflow; their low parts are the signature
    total = [F.pmod(F.sum(h.cast("decimal(38,0)")), F.lit(2**62).cast("decimal(38,0)")).cast("string") for h in (h1, h2)]
    found = parts.groupBy("folder").agg(F.sum("n").alias("n_files"), F.count("*").alias("n_contents"), F.sum(F.col("size") * F.col("n")).alias("bytes"), *[t.alias(f"_s{i}") for i, t in enumerate(total)])
    found = found.where(F.col("n_files") >= min_files)
    return found.select("folder", F.concat_ws(":", "n_contents", "_s0", "_s1").alias("signature"), "n_files", "n_contents", "bytes")


def deepest(found: DataFrame) -> DataFrame:
    """Folders without those that have a deeper folder of the same signature below them."""
    lower = found.select(F.col("signature"), F.col("folder").alias("_below"))
    up = lower.select("signature", F.explode(paths.ancestors("_below")).alias("folder"))
    return found.join(up, ["signature", "folder"], "left_anti")


def exact_groups(files: DataFrame, min_files: int = 2) -> DataFrame:
    """(signature, n_folders, first_folder, n_files, bytes, reclaimable): sets of folders with identical contents."""
    kept = deepest(folders(contents(files), min_files))
    grouped = kept.groupBy("signature").agg(F.count("*").alias("n_folders"), F.min("folder").alias("first_folder"), F.max("n_files").alias("n_files"), F.max("bytes").alias("bytes")).where("n_folders > 1")
    return grouped.withColumn("reclaimable", F.col("bytes") * (F.col("n_folders") - 1))


def overlaps(files: DataFrame, min_files: int = 2, threshold: float = 0.95, fan_out: int = FAN_OUT) -> DataFrame:
    """(left_folder, right_folder, shared_files, shared_bytes, coverage, kind): pairs of folders that share contents.

    coverage is the shared part of the smaller folder.  Pairs are opened by contents in at
    most fan_out folders (which bounds the pairs a content can open); an opened pair is
    measured over all contents.  A folder and its ancestor are no pair, nor are exact
    copies.
    """
    parts = cut(contents(files))  # used four times
    kept = cut(deepest(folders(parts, min_files)))
    held = parts.join(kept.select("folder"), "folder")
    spread = held.groupBy("md5").agg(F.count("*").alias("_f"))
    opening = held.join(spread.where((F.col("_f") > 1) & (F.col("_f") <= fan_out)), "md5")
    a, b = (opening.select("md5", F.col("folder").alias(f"{side}_folder"), F.col("n").alias(f"_n{side[0]}"), F.col("size").alias(f"_s{side[0]}")) for side in ("left", "right"))
    apart = ~paths.is_ancestor(F.col("left_folder"), F.col("right_folder")) & ~paths.is_ancestor(F.col("right_folder"), F.col("left_folder"))
    common = F.least("_nl", "_nr")
    measures = [common.alias("_files"), (common * F.least("_sl", "_sr")).alias("_bytes")]
    # contents in few folders are measured where they open a pair; of the others only the opened pairs' folders are looked at
    low = a.join(b, "md5").where((F.col("left_folder") < F.col("right_folder")) & apart).select("left_folder", "right_folder", *measures)
    wide = held.join(spread.where(F.col("_f") > fan_out).select("md5"), "md5")
    lefts = wide.select(F.col("folder").alias("left_folder"), "md5", F.col("n").alias("_nl"), F.col("size").alias("_sl"))
    rights = wide.select(F.col("folder").alias("right_folder"), "md5", F.col("n").alias("_nr"), F.col("size").alias("_sr"))
    pairs = low.select("left_folder", "right_folder").distinct()
    high = pairs.join(lefts, "left_folder").join(rights, ["right_folder", "md5"]).select("left_folder", "right_folder", *measures)
    shared = low.unionByName(high).groupBy("left_folder", "right_folder").agg(F.sum("_files").alias("shared_files"), F.sum("_bytes").alias("shared_bytes"))
    size = kept.select("folder", "bytes", "signature")
    both = shared.join(size.toDF("left_folder", "left_bytes", "_gl"), "left_folder").join(size.toDF("right_folder", "right_bytes", "_gr"), "right_folder").where("_gl <> _gr")
    cover = F.col("shared_bytes") / F.nullif(F.least("left_bytes", "right_bytes"), F.lit(0))
    both = both.withColumn("_c", cover).where(F.col("_c") >= threshold)
    return both.select("left_folder", "right_folder", "shared_files", "shared_bytes", F.round("_c", 4).alias("coverage"), F.when(F.col("_c") >= 0.95, "likely_duplicate_pack").otherwise("overlapping_pack").alias("kind"))


def plan(found: DataFrame, kept: DataFrame) -> DataFrame:
    """For each overlapping pair the folder to give up (fewer bytes, fewer files, the later path) and the action."""
    size = kept.select("folder", "bytes", "n_files")
    rows = found.join(size.toDF("left_folder", "lb", "ln"), "left_folder").join(size.toDF("right_folder", "rb", "rn"), "right_folder")
    left_goes = F.struct("lb", "ln") < F.struct("rb", "rn")
    source = F.when(left_goes, F.col("left_folder")).otherwise(F.col("right_folder"))
    target = F.when(left_goes, F.col("right_folder")).otherwise(F.col("left_folder"))
    return rows.select(source.alias("source"), target.alias("target"), "coverage", F.when(F.col("coverage") >= 1.0, "quarantine").otherwise("review").alias("action"))
