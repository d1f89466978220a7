"""Snapshots: upserts, child rows, differences, incremental scans, event logs, expressed as new DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new put in by key; columns in keep_old (such as created_at) stay as they were.

    new must hold each key once (``latest`` makes it so).  NULL keys match NULL.
    """
    o, n = old.withColumn("_o", F.lit(True)), new.withColumn("_n", F.lit(True))
    a, b = o.alias("a"), n.alias("b")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, cond, "full_outer")
    out = []
    for c in old.columns:
        if c not in new.columns:
            out.append(F.col(f"a.{c}").alias(c))
        elif c in keep_old:
            out.append(F.when(F.col("_o"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.when(F.col("_n"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return both.select(*out)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by the order columns; an aggregation with map-side combining, no window."""
    body = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(body, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_b")).select(*keys, "_b.*")


def replace_children(old: DataFrame, new: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """Child rows with those of changed parents replaced."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new whose key it lacks; of equal new keys one."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys).distinct(), list(keys), "left_anti"))


def difference(old: DataFrame, new: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """(key, status): registered, updated, unchanged or missing, in one full outer join."""
    a = old.select(F.col(key), F.struct(*compare).alias("_a"))
    b = new.select(F.col(key), F.struct(*compare).alias("_b"))
    status = F.when(F.col("_a").isNull(), "registered").when(F.col("_b").isNull(), "missing").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


MODES = {"index": (), "audio": ("audio",), "metadata": ("metadata",), "hash": ("hash",), "full": ("audio", "metadata", "hash")}


def satisfied(mode: str) -> Column:
    """A stored row already holds all that a scan in this mode would find."""
    have = {"audio": F.col("sample_rate").isNotNull(), "metadata": F.col("metadata_scanned_at").isNotNull(), "hash": F.col("md5").isNotNull()}
    out = F.lit(True)
    for need in MODES[mode]:
        out = out & have[need]
    return out


def to_scan(listing: DataFrame, current: DataFrame, mode: str = "full", force: bool = False) -> DataFrame:
    """(path, size_bytes, mtime, reason) of listed files that are new, changed in size or time, or not yet enriched."""
    held = current.select("path", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), satisfied(mode).alias("_ok"))
    rows = listing.join(held, "path", "left")
    same = F.col("_size").eqNullSafe(F.col("size_bytes")) & F.col("_mtime").eqNullSafe(F.col("mtime"))
    reason = F.when(F.col("_ok").isNull(), "new").when(F.lit(force), "forced").when(~same, "changed").when(~F.col("_ok"), "incomplete")
    return rows.select(*listing.columns, reason.alias("reason")).where("reason IS NOT NULL")


def drift(plan: DataFrame, files: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """plan rows (file_id, path, size_bytes, mtime, md5) with the first reason why they no longer hold, NULL if they do."""
    f = files.select(F.col("id").alias("file_id"), F.col("path").alias("_path"), F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), F.col("md5").alias("_md5"))
    rows = plan.join(f, "file_id", "left")
    reason = (
        F.when(F.col("_path").isNull(), "not_indexed").when(F.col("path") != F.col("_path"), "path_changed").when(F.col("size_bytes") != F.col("_size"), "size_changed")
        .when(F.abs(F.col("mtime") - F.col("_mtime")) > tolerance, "mtime_changed").when(F.col("md5") != F.col("_md5"), "content_changed")
    )
    return rows.withColumn("drift", reason).drop("_path", "_size", "_mtime", "_md5")


def job_states(events: DataFrame) -> DataFrame:
    """Latest state of each job from its append-only events (job_id, at, status, ...)."""
    return latest(events, ["job_id"], [F.col("at"), F.col("event_id")])


def reviewed(entries: DataFrame, approve: Column, reject: Column) -> DataFrame:
    """entries with review_status; a rejection overrides an approval made with it."""
    return entries.withColumn("review_status", F.when(F.coalesce(reject, F.lit(False)), "rejected").when(F.coalesce(approve, F.lit(False)), "approved").otherwise(F.coalesce("review_status", F.lit("pending"))))


def plan_counts(plan: DataFrame, *by: str) -> DataFrame:
    """(dimension, key, n): counts of a plan by each of several columns in one pass."""
    long = plan.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")) for c in by])).alias("x"))
    return long.groupBy("x.dimension", "x.key").agg(F.count("*").alias("n"))


def conflicts(entries: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """entries with conflict: their key is given different values; counted by aggregation, joined back."""
    n = entries.groupBy(*keys).agg((F.count_distinct(value) > 1).alias("conflict"))
    return entries.join(n, list(keys))


def write_plan(tags: DataFrame, embedded: DataFrame, keys: DataFrame) -> DataFrame:
    """What to embed in files: (file_id, namespace, key, value, existing, action).

    keys (field, namespace, key) maps fields to places.  action: 'conflict' for several
    values of one place, 'skip_same' where the place holds the value, 'replace' or 'add'.
    """
    wanted = tags.select("file_id", "field", "value").join(small(keys), "field").select("file_id", "namespace", "key", "value").distinct()
    wanted = conflicts(wanted, ["file_id", "namespace", "key"])
    held = embedded.groupBy("file_id", "namespace", "key").agg(F.min("value").alias("existing"))
    rows = wanted.join(held, ["file_id", "namespace", "key"], "left")
    action = F.when(F.col("conflict"), "conflict").when(F.col("existing") == F.col("value"), "skip_same").when(F.col("existing").isNotNull(), "replace").otherwise("add")
    return rows.select("file_id", "namespace", "key", "value", "existing", action.alias("action"))


def selected(plan: DataFrame, **wanted: Sequence[str]) -> DataFrame:
    """plan entries whose columns hold one of the wanted values, whatever the case; an empty list selects all."""
    for column, values in wanted.items():
        if values:
            plan = plan.where(F.lower(F.col(column)).isin([v.strip().lower() for v in values]))
    return plan


def staleness(artifacts: DataFrame, root: str, newest: DataFrame) -> DataFrame:
    """artifacts (path, root, created_at) with the reason why one cannot be used again, NULL if it can.  newest: one row (last_scan)."""
    rows = artifacts.crossJoin(F.broadcast(newest.select("last_scan")))  # one row
    reason = F.when(F.col("root").isNull(), "no_root").when(F.col("root") != root, "other_root").when(F.col("created_at").isNull(), "no_time").when(F.col("created_at") < F.col("last_scan"), "older_than_scan")
    return rows.withColumn("stale", reason).drop("last_scan")


def merge_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """Feedback by normal pair: the smaller (file, segment) left, the later state kept, created_at of the first."""
    a = F.struct(F.col("left_file_id").alias("f"), F.coalesce("left_segment_index", F.lit(-1)).alias("s"))
    b = F.struct(F.col("right_file_id").alias("f"), F.coalesce("right_segment_index", F.lit(-1)).alias("s"))

    def normal(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).withColumns({
            "left_file_id": F.col("_a.f"), "left_segment_index": F.col("_a.s"), "right_file_id": F.col("_b.f"), "right_segment_index": F.col("_b.s"),
        })
        return rows.drop("_a", "_b").select(*df.columns)

    keys = ["backend", "scope", "left_file_id", "left_segment_index", "right_file_id", "right_segment_index"]
    return upsert(normal(old), latest(normal(new), keys, [F.col("updated_at")]).select(*new.columns), keys, ["created_at"])


def expired(files: DataFrame, keep_days: int, today: str, pattern: str = r"(\d{8})_(\d{6})") -> DataFrame:
    """Backup paths whose stamp is older than keep_days; paths without a stamp stay."""
    stamp = F.to_date(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")), "yyyyMMdd")
    return files.withColumn("stamp", stamp).where(F.col("stamp") < F.date_sub(F.lit(today).cast("date"), keep_days))
