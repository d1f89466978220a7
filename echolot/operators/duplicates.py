"""Exact duplicates by content hash: groups, summary, election of the copy to keep, comparison with an import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths


def groups(files: DataFrame, hash_col: str = "md5") -> DataFrame:
    """(hash, n_files, size_bytes, first_path, wasted_bytes) of contents held by two or more readable files.

    size_bytes is the largest recorded, first_path the smallest.  NULL hashes form no
    group.  A group of any size is one small row; ``members`` gives its files.
    """
    rows = files.where(F.col(hash_col).isNotNull() & F.col("scan_error").isNull())
    found = rows.groupBy(F.col(hash_col).alias("hash")).agg(F.count("*").alias("n_files"), F.max("size_bytes").alias("size_bytes"), F.min("path").alias("first_path")).where("n_files > 1")
    return found.withColumn("wasted_bytes", F.col("size_bytes") * (F.col("n_files") - 1))


def members(files: DataFrame, hash_col: str = "md5") -> DataFrame:
    """(hash, id, path) of every file in a group."""
    rows = files.where(F.col(hash_col).isNotNull() & F.col("scan_error").isNull())
    return rows.join(groups(files, hash_col).select("hash"), F.col(hash_col) == F.col("hash")).select("hash", "id", "path")


def summary(files: DataFrame, hash_col: str = "md5") -> DataFrame:
    """One row: groups, files, extra copies, wasted bytes, and the hash that wastes most (the smallest on a tie)."""
    return groups(files, hash_col).agg(
        F.count("*").alias("n_groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).alias("extra_copies"),
        F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"), F.min_by("hash", F.struct(-F.coalesce("wasted_bytes", F.lit(0)), F.col("hash"))).alias("largest"),
    )


#: Up to so many safe folders go into the plan as literals; more are joined on the ancestors of a path.
MAX_LITERAL_RULES = 200


def protected(files: DataFrame, folders: DataFrame, path_col: str = "path", both_ways: bool = False) -> DataFrame:
    """files with protected_by, protected_order: the first (rule_order, folder) safe folder a path lies in; both_ways: or that lies below the path.

    Few rules are tests within the scan of the files.  More are joined by equality: every
    folder above a path with the rules, and with both_ways every folder above a rule with
    the path.
    """
    rules = folders.select("rule_order", "folder", paths.path_key("folder").alias("_rule")).where("_rule IS NOT NULL AND rule_order IS NOT NULL")
    head = sorted((tuple(r) for r in rules.limit(MAX_LITERAL_RULES + 1).collect()), key=lambda r: (r[0], r[1]))
    keyed = files.withColumn("_key", paths.path_key(path_col))
    if len(head) <= MAX_LITERAL_RULES:
        first = F.lit(None).cast("struct<rule_order:int,folder:string>")
        for order, folder, key in reversed(head):
            inside = (F.col("_key") == key) | F.col("_key").startswith(key + "/")
            if both_ways:
                inside = inside | F.lit(key).startswith(F.concat("_key", F.lit("/")))
            first = F.when(inside, F.struct(F.lit(order).cast("int").alias("rule_order"), F.lit(folder).alias("folder"))).otherwise(first)
        return keyed.withColumn("_r", first).withColumns({"protected_by": F.col("_r.folder"), "protected_order": F.col("_r.rule_order")}).drop("_key", "_r")
    above = lambda c: F.array_union(F.array(c), paths.folders_above(c))
    hits = keyed.select("id", F.explode(above(F.col("_key"))).alias("_rule")).join(rules, "_rule").select("id", "rule_order", "folder")
    if both_ways:
        below = rules.select("rule_order", "folder", F.explode(paths.folders_above(F.col("_rule"))).alias("_key"))
        hits = hits.unionByName(keyed.select("id", "_key").join(below, "_key").select("id", "rule_order", "folder"))
    best = hits.groupBy("id").agg(F.min(F.struct("rule_order", "folder")).alias("_r")).select("id", F.col("_r.folder").alias("protected_by"), F.col("_r.rule_order").alias("protected_order"))
    return keyed.drop("_key").join(best, "id", "left")


def keep_order(folder_rank: Column, safe: Column, extensions: Sequence[str]) -> list[Column]:
    """Sort keys of the election: safe copies, preferred folders, preferred extensions, path."""
    ext = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.lower("extension"))
    return [F.when(safe, 0).otherwise(1), F.coalesce(folder_rank, F.lit(2**31 - 1)), F.when(ext > 0, ext).otherwise(len(extensions) + 1), F.col("path")]


def keep_plan(files: DataFrame, folders: DataFrame, hash_col: str = "md5", extensions: Sequence[str] = (".wav", ".aif", ".flac")) -> DataFrame:
    """(hash, id, path, rank, action): per group 'keep' for the first, 'ignore' for protected others, 'remove' for the rest.

    The kept row is found by an aggregation with map-side combining, so that a hash held
    by very many files is not sorted in one task; rank is 1 for it and 2 for the others.
    """
    rows = files.where(F.col(hash_col).isNotNull() & F.col("scan_error").isNull())
    rows = protected(rows, folders)
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keep_order(F.col("protected_order"), F.col("protected_by").isNotNull(), extensions))], F.col("id").alias("k_id"))
    best = rows.groupBy(F.col(hash_col).alias("hash")).agg(F.count("*").alias("n"), F.min(key).alias("best")).where("n > 1").select("hash", F.col("best.k_id").alias("keep_id"))
    joined = rows.join(best, F.col(hash_col) == F.col("hash"))
    kept = F.col("id") == F.col("keep_id")
    action = F.when(kept, "keep").when(F.col("protected_by").isNotNull(), "ignore").otherwise("remove")
    return joined.select("hash", "id", "path", F.when(kept, 1).otherwise(2).alias("rank"), action.alias("action"))


def compare(candidates: DataFrame, files: DataFrame, hash_col: str = "md5") -> DataFrame:
    """Import candidates with the number and first path of indexed files of the same content; status 'exists', 'new' or 'unhashed'."""
    held = files.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("_h")).agg(F.count("*").alias("matches"), F.min("path").alias("first_match"))
    rows = candidates.join(held, F.col(hash_col) == F.col("_h"), "left").drop("_h")
    status = F.when(F.col(hash_col).isNull(), "unhashed").when(F.col("matches").isNotNull(), "exists").otherwise("new")
    return rows.withColumn("status", status).withColumn("matches", F.coalesce("matches", F.lit(0)))


def processed(files: DataFrame) -> DataFrame:
    """(id, path, processed_words, likely_source, confidence): rendered variants and the file they come from.

    A source has no processing word and the same remaining name in the same folder; of
    several the last path is taken.
    """
    rows = files.where(F.col("scan_error").isNull()).withColumn("_stem", F.coalesce("stem", paths.stem("path")))
    rows = rows.select("id", "path", paths.parent("path").alias("_folder"), names.processed_words(F.col("_stem")).alias("processed_words"), names.unprocessed_key(F.col("_stem")).alias("_key"))
    source = rows.where((F.size("processed_words") == 0) & (F.col("_key") != "")).groupBy("_folder", "_key").agg(F.max("path").alias("likely_source"))
    made = rows.where(F.size("processed_words") > 0).join(source, ["_folder", "_key"], "left")
    return made.select("id", "path", "processed_words", "likely_source", F.when(F.col("likely_source").isNotNull(), "high").otherwise("review").alias("confidence"))
