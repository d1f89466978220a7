"""Queries over descriptors and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import similarity
from ..session import small, table
from .registry import query

_D = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))"


@query(f"SELECT b.vec_id AS id, round({_D}, 6) AS distance, round(1 / (1 + {_D}), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 7 AND b.vec_id <> 7 ORDER BY {_D}, b.vec_id LIMIT 20")
def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """20 vectors nearest to one."""
    e = table(spark, sf, "embeddings")
    found = similarity.search(e, e.where("vec_id = 7"), "vec_id", "embedding", 20)
    return found.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


_PAIRS = f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, 1 / (1 + {_D}) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE 1 / (1 + {_D}) >= 0.45"


@query(f"SELECT left_id, right_id, round(score, 6) AS score FROM ({_PAIRS})")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar vectors of one label."""
    found = similarity.pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"], 0.45)
    return found.withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE e AS ({_PAIRS}), s AS (SELECT left_id AS u, right_id AS v FROM e UNION ALL SELECT right_id, left_id FROM e), r(id, c) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.id)
    SELECT id, min(c) AS component FROM r GROUP BY id""")
def similar_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of the similar pairs."""
    found = similarity.pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", ["label"], 0.45)
    return similarity.components(found)


def _c(x: str) -> str:
    return f"CAST(floor(1.5 * ln(1 + coalesce({x}, 0))) AS INTEGER)"


@query(f"""SELECT b_duration, b_zcr, b_centroid, b_rolloff, count(*) AS n FROM (SELECT CASE WHEN duration_s < 1 THEN 'subsecond' WHEN duration_s < 10 THEN 'short' WHEN duration_s < 60 THEN 'medium' WHEN duration_s < 300 THEN 'long' WHEN duration_s IS NOT NULL THEN 'very_long' END AS b_duration,
    {_c('zero_crossing_rate')} AS b_zcr, {_c('spectral_centroid')} AS b_centroid, {_c('spectral_rolloff')} AS b_rolloff FROM audio_segments WHERE NOT isnan(coalesce(zero_crossing_rate, 0)) AND NOT isnan(coalesce(spectral_centroid, 0)) AND NOT isnan(coalesce(spectral_rolloff, 0))) GROUP BY ALL""")
def segment_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the blocks that segment pairs are searched in."""
    known = " AND ".join(f"NOT isnan(coalesce({c}, 0))" for c in ("zero_crossing_rate", "spectral_centroid", "spectral_rolloff"))
    return table(spark, sf, "audio_segments").where(known).select(*similarity.block_key()).groupBy("b_duration", "b_zcr", "b_centroid", "b_rolloff").agg(F.count("*").alias("n"))


@query("SELECT id, round(peak, 6) AS f0, round(ln(1 + coalesce(spectral_centroid, 0)) / 10, 6) AS f4, round(least(coalesce(crest_factor, 0), 20) / 20, 6) AS f2 FROM audio_segments WHERE peak IS NOT NULL AND rms IS NOT NULL AND NOT isnan(coalesce(spectral_centroid, 0)) AND NOT isnan(peak) AND NOT isnan(coalesce(crest_factor, 0))")
def segment_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the segment vectors."""
    known = "NOT isnan(coalesce(spectral_centroid, 0)) AND NOT isnan(peak) AND NOT isnan(coalesce(crest_factor, 0))"
    rows = table(spark, sf, "audio_segments").where(known).withColumn("v", similarity.segment_vector()).where("v IS NOT NULL")
    return rows.select("id", *[F.round(F.get("v", F.lit(i)), 6).alias(f"f{i}") for i in (0, 4, 2)])


@query("""SELECT least(a.file_id, b.file_id) AS left_file, greatest(a.file_id, b.file_id) AS right_file, count(*) AS n FROM audio_segments a JOIN audio_segments b ON b.id = a.id + 1 GROUP BY ALL""")
def feedback_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback on neighbouring segments, by normal pair of files."""
    s = table(spark, sf, "audio_segments").select("id", "file_id")
    other = s.select((F.col("id") - 1).alias("id"), F.col("file_id").alias("other"))
    rows = s.join(other, "id").select(*similarity.feedback_key(F.col("file_id"), F.lit(None).cast("int"), F.col("other"), F.lit(None).cast("int")))
    return rows.groupBy(F.col("left.file").alias("left_file"), F.col("right.file").alias("right_file")).agg(F.count("*").alias("n"))


@query("""SELECT file_id, count(*) AS segments, round(sum(duration_s), 3) AS seconds, max(peak) AS peak, min(start_s) AS first_start FROM audio_segments WHERE NOT isnan(coalesce(peak, 0)) GROUP BY file_id""")
def segment_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Segments by file."""
    rows = table(spark, sf, "audio_segments").where("NOT isnan(coalesce(peak, 0))")
    return rows.groupBy("file_id").agg(F.count("*").alias("segments"), F.round(F.sum("duration_s"), 3).alias("seconds"), F.max("peak").alias("peak"), F.min("start_s").alias("first_start"))


@query(f"""WITH RECURSIVE e AS ({_PAIRS}), s AS (SELECT left_id AS u, right_id AS v FROM e UNION ALL SELECT right_id, left_id FROM e), r(id, c) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.id),
    l AS (SELECT id, min(c) AS component FROM r GROUP BY id) SELECT l.component, count(DISTINCT l.id) AS members, count(e.left_id) AS pairs, round(max(e.score), 6) AS best_score, 0 AS exact_pairs FROM l LEFT JOIN e ON e.left_id = l.id GROUP BY l.component""")
def near_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of similar vectors with their pairs."""
    e = table(spark, sf, "embeddings")
    found = similarity.near_duplicates(similarity.pairs(e, "vec_id", "embedding", ["label"], 0.45), e, "vec_id")
    return found.withColumn("best_score", F.round("best_score", 6)).withColumn("exact_pairs", F.col("exact_pairs").cast("int"))


def _vec(t: str) -> list[str]:
    log = [f"ln(1 + coalesce({t}.{c}, 0)) / 10" for c in ("zero_crossing_rate", "spectral_centroid", "spectral_rolloff")]
    return [f"{t}.peak", f"{t}.rms", f"least(coalesce({t}.crest_factor, 0), 20) / 20", *log, f"coalesce({t}.spectral_flatness, 0)"]


_SD = "sqrt(" + " + ".join(f"({a} - {b}) ** 2" for a, b in zip(_vec("a"), _vec("b"))) + ")"
_KNOWN = " AND ".join(f"NOT isnan(coalesce({c}, 0))" for c in ("peak", "rms", "crest_factor", "zero_crossing_rate", "spectral_centroid", "spectral_rolloff", "spectral_flatness", "duration_s"))


def _distinct(segments: DataFrame) -> DataFrame:
    """Distinct rows: only those whose id occurs again are compared."""
    again = small(segments.groupBy("id").count().where("count > 1").select("id"))
    return segments.join(again, "id", "left_anti").unionByName(segments.join(again, "id", "left_semi").distinct())


@query(f"""WITH s AS (SELECT DISTINCT *, CASE WHEN duration_s < 1 THEN 'subsecond' WHEN duration_s < 10 THEN 'short' WHEN duration_s < 60 THEN 'medium' WHEN duration_s < 300 THEN 'long' WHEN duration_s IS NOT NULL THEN 'very_long' END AS b1,
    {_c('zero_crossing_rate')} AS b2, {_c('spectral_centroid')} AS b3, {_c('spectral_rolloff')} AS b4 FROM audio_segments WHERE peak IS NOT NULL AND rms IS NOT NULL AND {_KNOWN})
    SELECT a.id AS left_id, b.id AS right_id, round(1 / (1 + {_SD}), 6) AS score FROM s a JOIN s b ON a.b1 IS NOT DISTINCT FROM b.b1 AND a.b2 = b.b2 AND a.b3 = b.b3 AND a.b4 = b.b4 AND a.id < b.id AND a.file_id IS DISTINCT FROM b.file_id
    AND abs(a.peak - b.peak) < 0.011 WHERE 1 / (1 + {_SD}) >= 0.99""")
def similar_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of different files that sound nearly the same, found block by block."""
    rows = _distinct(table(spark, sf, "audio_segments").where(_KNOWN)).withColumn("v", similarity.segment_vector()).select("id", "file_id", "v", *similarity.block_key())
    found = similarity.pairs(rows, "id", "v", ["b_duration", "b_zcr", "b_centroid", "b_rolloff"], 0.99, "file_id", parts=7)
    return found.withColumn("score", F.when(F.col("score") == 1, F.lit(1.0)).otherwise(F.round("score", 6)))  # rounding is slow, and most are 1
