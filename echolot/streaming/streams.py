"""Structured Streaming forms of the incremental operators.  All work on batch DataFrames too."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.snapshots import latest, upsert


def events(spark: SparkSession, folder: str, schema: str, per_trigger: int = 50) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """df with a watermark; a stream's time without zone is read in the session's zone."""
    if df.isStreaming and dict(df.dtypes)[ts] == "timestamp_ntz":
        df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late)


def windowed(df: DataFrame, ts: str, size: str, slide: str | None, late: str, *keys: str, value: str) -> DataFrame:
    """(start, end, keys, n, total): tumbling or sliding windows; what comes later than the watermark is dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = _timed(df, ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n): stretches of events of a key no further apart than gap."""
    out = _timed(df, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, ts: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return _timed(df, ts, late).dropDuplicatesWithinWatermark(list(keys))


class SnapshotSink:
    """foreachBatch target: each micro-batch is put into a new snapshot version by key.

    Versions are folders; a version counts once its folder is complete, so a batch run
    again after a lost executor or driver writes the same version again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], order: Sequence[str]):
        self.spark, self.folder, self.keys, self.order = spark, PurePosixPath(folder), list(keys), list(order)

    def _path(self, version: int) -> str:
        return str(self.folder / f"v={version:012d}")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def newest(self, below: int | None = None) -> int | None:
        """The newest complete version (below a batch's own), None before the first."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(str(self.folder))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        held = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        versions = sorted((int(n[2:]) for n in held if n.startswith("v=") and n[2:].isdigit()), reverse=True)
        return next((v for v in versions if (below is None or v < below) and self._exists(self._path(v))), None)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(version))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        new = latest(batch, self.keys, [F.col(c) for c in self.order])
        before = self.newest(batch_id)
        if before is not None:
            new = upsert(self.read(before), new, self.keys)
        new.write.mode("overwrite").parquet(self._path(batch_id))

    def writer(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
