"""Spark session and checkpoint settings shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults set only where a session is made here; a given session keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def make_session(cpus: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(map=DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers of every executor, once per context."""
    context = spark.sparkContext
    if not getattr(context, "_echolot_shipped", False):
        package = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="echolot-")) / "echolot_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in package.rglob("*.py"):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._echolot_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode without one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="echolot-checkpoints-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows up to which ``small`` broadcasts a table.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df as the broadcast side of a join if it has at most so many rows, which is looked up; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
