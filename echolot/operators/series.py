"""Related files (takes, channel sets) and inconsistent formats within them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths

FORMAT_FIELDS = ("sample_rate", "bit_depth", "channels")


def members(files: DataFrame) -> DataFrame:
    """Readable files that belong to a series: (id, path, stem, parent, key, marker, reason, format fields)."""
    rows = files.where("scan_error IS NULL AND stem IS NOT NULL").withColumn("_r", names.related(F.col("stem"))).where("_r IS NOT NULL")
    return rows.select("id", "path", "stem", paths.parent("path").alias("parent"), "_r.key", "_r.marker", "_r.reason", *FORMAT_FIELDS)


def groups(files: DataFrame, min_files: int = 2) -> DataFrame:
    """(parent, key, reason, n_files, shown_stem, markers, confidence), one row per series of at least min_files (2 or more).

    markers are sorted, numbers by value.  confidence is high for a channel set with both
    sides or a sequence with three different numbers, else medium.
    """
    by_marker = F.array_sort(F.collect_set(F.struct(F.when(F.col("marker").rlike(r"^\d+$"), F.col("marker").cast("int")).alias("n"), F.col("marker").alias("m"))))
    found = members(files).groupBy("parent", "key", "reason").agg(F.count("*").alias("n_files"), F.min_by("stem", F.struct("path", "id")).alias("shown_stem"), by_marker.alias("_m"))
    found = found.where(F.col("n_files") >= max(2, min_files)).withColumn("markers", F.col("_m.m"))
    sides = (F.array_contains("markers", "L") & F.array_contains("markers", "R")) | (F.array_contains("markers", "LEFT") & F.array_contains("markers", "RIGHT"))
    numbers = F.size(F.array_distinct(F.filter(F.col("_m.n"), lambda x: x.isNotNull()))) >= 3
    sure = ((F.col("reason") == "channel_set") & sides) | ((F.col("reason") == "numbered_sequence") & numbers)
    return found.withColumn("confidence", F.when(sure, "high").otherwise("medium")).drop("_m")


def inconsistent(files: DataFrame, min_files: int = 2) -> DataFrame:
    """Series in which a format field has several known values: the fields, their number, files."""
    spread = members(files).groupBy("parent", "key", "reason").agg(F.count("*").alias("n_files"), *[(F.count_distinct(f) > 1).alias(f) for f in FORMAT_FIELDS])
    spread = spread.where(F.col("n_files") >= max(2, min_files))
    fields = F.filter(F.array(*[F.when(F.col(f), F.lit(f)) for f in FORMAT_FIELDS]), lambda x: x.isNotNull())
    return spread.select("parent", "key", "reason", "n_files", fields.alias("fields"), F.size(fields).alias("n_fields")).where("n_fields > 0")
