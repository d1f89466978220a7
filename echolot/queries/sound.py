"""Signal queries: sound files are made of numbers of the tables, so that SQL knows what must come out."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import snapshots
from ..session import table
from ..signal import descriptors, riff
from ..sources import readers
from .registry import query

RATE = 1000


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


@F.pandas_udf(T.BinaryType())
def _wave(samples: pd.Series, channels: pd.Series, title: pd.Series) -> pd.Series:
    """16-bit sound files of given samples, with a title."""
    out = []
    for x, n, t in zip(samples, channels, title):
        body = _chunk(b"fmt ", struct.pack("<HHIIHH", 1, n, RATE, RATE * 2 * n, 2 * n, 16)) + _chunk(b"data", struct.pack(f"<{len(x)}h", *x)) + _chunk(b"LIST", b"INFO" + _chunk(b"INAM", t.encode() + b"\0"))
        out.append(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body)
    return pd.Series(out)


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, samples): a supplier's quantities in the order of their lines, every second one turned round."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.struct("l_orderkey", "l_linenumber", (F.col("l_quantity") * 600 * sign).cast("int").alias("v")).alias("x"))
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("file_id", F.col("x.v").alias("samples"))  # a small fixture: one sound a supplier


def _mono(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("file_id", _wave("samples", F.lit(1), F.concat(F.lit("Supplier "), F.col("file_id"))).alias("content"))


_X = "x AS (SELECT l_suppkey AS file_id, l_orderkey, l_linenumber, l_quantity * 600 * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END / 32768 AS v FROM lineitem)"


@query(f"WITH {_X} SELECT file_id, 1000 AS sample_rate, 16 AS bit_depth, 1 AS channels, count(*) / 1000 AS duration_s, 'PCM_16' AS subtype, 1 AS has_riff_info, 0 AS has_bext FROM x GROUP BY file_id")
def sound_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header fields of sound files."""
    rows = _mono(spark, sf).withColumn("i", riff.audio_info("content"))
    return rows.select("file_id", *[f"i.{c}" for c in ("sample_rate", "bit_depth", "channels", "duration_s", "subtype", "has_riff_info", "has_bext")])


@query("SELECT DISTINCT l_suppkey AS file_id, 'riff_info' AS namespace, 'inam' AS key, 'Supplier ' || l_suppkey AS value FROM lineitem")
def sound_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded fields of sound files as rows."""
    rows = _mono(spark, sf).select("file_id", F.explode(riff.embedded_fields("content")).alias("f"))
    return rows.select("file_id", "f.namespace", "f.key", "f.value")


@query(f"""WITH {_X}, y AS (SELECT *, v < 0 AS neg, lag(v < 0) OVER (PARTITION BY file_id ORDER BY l_orderkey, l_linenumber) AS before FROM x)
    SELECT file_id, round(max(abs(v)), 4) AS peak, round(sqrt(avg(v * v)), 4) AS rms, round(max(abs(v)) / sqrt(avg(v * v)), 2) AS crest, round(count(*) FILTER (neg <> before) / (count(*) / 1000), 1) AS crossings, CAST(count(*) FILTER (abs(v) >= 0.999) AS DOUBLE) AS clipped FROM y GROUP BY file_id""")
def sound_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels and zero crossings of sound files."""
    found = descriptors.file_descriptors(_mono(spark, sf))
    r = lambda c, n: F.round(c, n)
    return found.select("file_id", r("peak", 4).alias("peak"), r("rms", 4).alias("rms"), r("crest_factor", 2).alias("crest"), r("zero_crossing_rate", 1).alias("crossings"), F.col("clipping_count").alias("clipped"))


@query("SELECT l_suppkey AS file_id, 'exact' AS confidence, 0.0::DOUBLE AS gap FROM lineitem GROUP BY l_suppkey HAVING l_suppkey % 3 <> 0")
def dual_mono_files(spark: SparkSession, sf: str) -> DataFrame:
    """Stereo files with one sound on both channels (made so unless the supplier's number is divisible by three)."""
    other = lambda v: F.when(F.col("file_id") % 3 == 0, v + 7).otherwise(v)
    stereo = _samples(spark, sf).withColumn("samples", F.flatten(F.transform("samples", lambda v: F.array(v, other(v)))))
    return descriptors.dual_mono(stereo.select("file_id", _wave("samples", F.lit(2), F.lit("x")).alias("content"))).select("file_id", "confidence", F.col("max_abs_difference").alias("gap"))


@query("""SELECT p.file_id, p.field, p.value FROM (SELECT DISTINCT file_id, field, value FROM accepted_tags t JOIN files f ON f.id = t.file_id WHERE field IS NOT NULL AND value IS NOT NULL AND source <> 'manual' AND f.mtime IS NOT NULL) p
    WHERE NOT EXISTS (SELECT 1 FROM accepted_tags h WHERE h.source = 'manual' AND h.file_id = p.file_id AND h.field = p.field AND h.value = p.value)""")
def sidecar_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Tags written into sidecar documents and read back: those that the files do not have by hand."""
    files, rows = table(spark, sf, "files"), table(spark, sf, "accepted_tags").where("field IS NOT NULL AND value IS NOT NULL")
    docs = readers.sidecars(files, rows.where("source <> 'manual'")).where("mtime IS NOT NULL")
    return readers.from_sidecars(docs, files, rows.where("source = 'manual'")).select("file_id", "field", "value")


@query("""SELECT cat_id AS artifact_id, 'synonyms' AS row_type, CAST(n - 1 AS INTEGER) AS row_index, synonyms[n] AS word FROM (SELECT cat_id, synonyms, unnest(range(1, len(synonyms) + 1)) AS n FROM ucs_entries)
    UNION ALL SELECT cat_id, 'names', 0, subcategory FROM ucs_entries UNION ALL SELECT cat_id, 'names', 1, category FROM ucs_entries""")
def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of several lists of each document as rows."""
    wrapped = lambda c: F.transform(c, lambda x: F.struct(x.alias("word")))
    docs = table(spark, sf, "ucs_entries")
    rows = readers.document_rows(docs, "cat_id", {"synonyms": wrapped("synonyms"), "names": wrapped(F.array("subcategory", "category"))})
    return rows.select("artifact_id", "row_type", "row_index", F.get_json_object("body", "$.word").alias("word"))


@query("""SELECT left_file_id, right_file_id, arg_max(state, w) AS state FROM (SELECT least(file_id, id % 97 + 1) AS left_file_id, greatest(file_id, id % 97 + 1) AS right_file_id, CASE WHEN confidence > 0.5 THEN 'confirmed' ELSE 'rejected' END AS state, id AS w
    FROM (SELECT DISTINCT id, file_id, confidence FROM accepted_tags) WHERE file_id <> id % 97 + 1) GROUP BY ALL""")
def feedback_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions on pairs put together, whichever way round, the later one kept."""
    rows = table(spark, sf, "accepted_tags").select("id", "file_id", "confidence").distinct()
    new = rows.select(
        F.lit("spectral").alias("backend"), F.lit("file").alias("scope"), F.col("file_id").alias("left_file_id"), F.lit(None).cast("int").alias("left_segment_index"), (F.col("id") % 97 + 1).alias("right_file_id"),
        F.lit(None).cast("int").alias("right_segment_index"), F.when(F.col("confidence") > 0.5, "confirmed").otherwise("rejected").alias("state"), F.timestamp_seconds("id").alias("created_at"), F.timestamp_seconds("id").alias("updated_at"),
    ).where("left_file_id <> right_file_id")
    return snapshots.merge_feedback(new.limit(0), new).select("left_file_id", "right_file_id", "state")


@query("""SELECT id, path, CAST(strptime(regexp_extract(stamp, '^([0-9]{8})', 1), '%Y%m%d') AS DATE) AS stamp FROM (SELECT id, path, strftime(scanned_at, '%Y%m%d_%H%M%S') AS stamp FROM files WHERE scanned_at IS NOT NULL) WHERE strptime(regexp_extract(stamp, '^([0-9]{8})', 1), '%Y%m%d') < DATE '2024-06-01' - INTERVAL 30 DAY""")
def backup_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Copies whose stamp (here the time of the scan) is older than thirty days."""
    rows = table(spark, sf, "files").where("scanned_at IS NOT NULL").select("id", F.col("path").alias("original"), F.concat(F.lit("/backup/"), F.date_format("scanned_at", "yyyyMMdd_HHmmss")).alias("path"))
    return snapshots.expired(rows, 30, "2024-06-01").select("id", F.col("original").alias("path"), "stamp")
