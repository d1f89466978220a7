"""Building and updating the index: list -> what changed -> enrich -> new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import audits
from ..plans import snapshots
from ..session import cut
from ..signal import riff
from . import readers, schemas

_AUDIO = ("sample_rate", "bit_depth", "channels", "duration_s", "subtype")
_FLAGS = ("has_bext", "has_ixml", "has_riff_info", "has_adm", "has_cue_markers", "has_sampler")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with their place (from 1) in the order of a column: ranges are sorted each by itself, and the counts of those before are added."""
    sorted_ = cut(rows.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("_p")).agg(F.count("*").alias("_size"))
    before = sizes.select("_p", (F.sum("_size").over(Window.orderBy("_p")) - F.col("_size")).alias("_before"))  # a row per partition
    return sorted_.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + place + 1).drop("_p", "_before", "_at")


def enriched(rows: DataFrame, mode: str, now: str, kept: list[str] | None = None) -> DataFrame:
    """Listed rows (with content) as index rows: header fields, flags, hash, category name, and kept columns; only what the mode asks for is computed."""
    parts = snapshots.MODES[mode]
    at = F.lit(now).cast("timestamp_ntz")
    i = F.col("_i")
    rows = rows.withColumn("_i", riff.audio_info("content")) if {"audio", "metadata"} & set(parts) else rows.withColumn("_i", F.lit(None).cast(riff.INFO))
    known = lambda on, c: c if on else F.lit(None)
    named = F.array(*[F.when(i[f] == 1, F.lit(f[4:])) for f in _FLAGS])
    out = rows.select(
        "path", "filename", "stem", "extension", "size_bytes", "mtime", known("hash" in parts, F.md5("content")).alias("md5"), *[known("audio" in parts, i[c]).alias(c) for c in _AUDIO],
        *[known("metadata" in parts, i[c]).alias(c) for c in _FLAGS], known("metadata" in parts, F.to_json(F.filter(named, lambda x: x.isNotNull()))).alias("metadata_sources"),
        names.ucs_parts(F.col("stem"))["is_ucs"].cast("int").alias("is_ucs"), i["error"].alias("scan_error"), known("hash" in parts, at).alias("hash_scanned_at"),
        known("audio" in parts, at).alias("audio_scanned_at"), known("metadata" in parts, at).alias("metadata_scanned_at"), at.alias("scanned_at"), *(kept or ()),
    )
    return out.withColumn("id", F.lit(None).cast("long"))


def scan(spark: SparkSession, root: str, files: DataFrame, issues: DataFrame, fields: DataFrame, mode: str = "full", now: str = "1970-01-01 00:00:00", force: bool = False) -> dict[str, DataFrame]:
    """New snapshots of files, fn_issues and metadata_fields after a scan of root.

    Only new, changed or not yet satisfied files are read.  Rows keep their id; new ones
    get the next ids in the order of paths (per batch of new files, by range).  Rows of
    files that are gone stay.  ``changed`` holds the rows that were read.
    """
    current = schemas.conformed(files, "files")
    todo = snapshots.to_scan(readers.listing(spark, root), current, mode, force).select("path")
    read = readers.listing(spark, root, with_content=True).join(todo, "path", "left_semi")
    embedded = "metadata" in snapshots.MODES[mode]
    new = cut(enriched(read.withColumn("_fields", riff.embedded_fields("content")) if embedded else read, mode, now, ["_fields"] if embedded else []))  # contents are read once
    last = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    old_ids = current.select("path", F.col("id").alias("_old"))
    with_ids = new.drop("id").join(old_ids, "path", "left")
    numbers = numbered(with_ids.where("_old IS NULL").select("path"), "path", "_n")
    with_ids = with_ids.join(numbers, "path", "left").crossJoin(F.broadcast(last)).withColumn("id", F.coalesce("_old", F.col("_last") + F.col("_n"))).drop("_old", "_n", "_last")  # one row
    with_ids = cut(with_ids)
    index = snapshots.upsert(current, schemas.conformed(with_ids, "files"), ["path"])
    found = audits.name_issues(with_ids, root).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("file_id"), "component", "issue", F.lit(None).cast("string").alias("detail"))
    changed = with_ids.select(F.col("id").alias("file_id"))
    out = {"files": index, "fn_issues": snapshots.replace_children(schemas.conformed(issues, "fn_issues"), found, "file_id", changed), "metadata_fields": schemas.conformed(fields, "metadata_fields"), "changed": with_ids}
    if embedded:
        rows = with_ids.select(F.col("id").alias("file_id"), F.explode("_fields").alias("f")).select("file_id", "f.namespace", "f.key", "f.value", F.lit("embedded").alias("source"), F.lit(now).cast("timestamp_ntz").alias("updated_at"))
        out["metadata_fields"] = snapshots.replace_children(out["metadata_fields"], rows.distinct(), "file_id", changed)
    return out


def backfill(files: DataFrame, content: DataFrame, mode: str, now: str) -> DataFrame:
    """files with the fields of a mode filled in for readable rows that lack them; content: (path, content)."""
    need = files.where("scan_error IS NULL").where(~snapshots.satisfied(mode)).select("path", "filename", "stem", "extension", "size_bytes", "mtime").join(content, "path")
    new = enriched(need, mode, now)
    filled = {"audio": [*_AUDIO, "audio_scanned_at"], "metadata": [*_FLAGS, "metadata_sources", "metadata_scanned_at"], "hash": ["md5", "hash_scanned_at"]}
    columns = [c for part in snapshots.MODES[mode] for c in filled[part]]
    return snapshots.upsert(files, new.select("path", *columns), ["path"])


def markdown(title: str, rows: DataFrame, limit: int = 200) -> str:
    """A report table as Markdown, at most limit rows."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    body = "\n".join("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.limit(limit).collect())
    return f"# {title}\n\n{head}\n{body}\n"
