"""Similarity of files and segments by descriptor vectors: search, blocked pairs, components, feedback."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small


def _log(name: str, by: float) -> Column:
    return F.log1p(F.coalesce(F.col(name), F.lit(0.0))) / F.lit(by)


def file_vector() -> Column:
    """12 features of a file; NULL without peak or rms."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    vector = F.array(
        F.col("peak"), F.col("rms"), F.least(z("crest_factor"), F.lit(20.0)) / 20, z("silence_ratio"), _log("clipping_count", 10), _log("zero_crossing_rate", 10),
        _log("transient_density", 5), _log("spectral_centroid", 10), _log("spectral_bandwidth", 10), _log("spectral_rolloff", 10), z("spectral_flatness"), _log("duration_s", 10),
    )
    return F.when(F.col("peak").isNotNull() & F.col("rms").isNotNull(), vector)


def segment_vector() -> Column:
    """7 features of a segment; NULL without peak or rms."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    vector = F.array(F.col("peak"), F.col("rms"), F.least(z("crest_factor"), F.lit(20.0)) / 20, _log("zero_crossing_rate", 10), _log("spectral_centroid", 10), _log("spectral_rolloff", 10), z("spectral_flatness"))
    return F.when(F.col("peak").isNotNull() & F.col("rms").isNotNull(), vector)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in double."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def score(d: Column) -> Column:
    return 1 / (1 + d)


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 1, "subsecond").when(seconds < 10, "short").when(seconds < 60, "medium").when(seconds < 300, "long").when(seconds.isNotNull(), "very_long")


def block_key() -> list[Column]:
    """Blocking keys of segments: duration bucket and coarse logarithms of three features."""
    coarse = lambda c: F.floor(1.5 * F.log1p(F.coalesce(F.col(c), F.lit(0.0)))).cast("int")
    return [duration_bucket(F.col("duration_s")).alias("b_duration"), coarse("zero_crossing_rate").alias("b_zcr"), coarse("spectral_centroid").alias("b_centroid"), coarse("spectral_rolloff").alias("b_rolloff")]


def search(items: DataFrame, query: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(id, distance, score, rank): the k items nearest to one query row, which is no answer itself.

    query: one row with the same columns; it is broadcast.  Ties by id.
    """
    q = F.broadcast(query.limit(1).select(F.col(id_col).alias("_qid"), F.col(vector_col).alias("_q")))
    near = items.where(F.col(vector_col).isNotNull()).crossJoin(q).where(F.col(id_col) != F.col("_qid"))  # one query row
    near = near.select(F.col(id_col).alias("id"), distance(F.col(vector_col), F.col("_q")).alias("distance")).orderBy("distance", "id").limit(k)
    return near.select("id", "distance", score(F.col("distance")).alias("score"))


#: Items that a cell holds before it is split for ``pairs``.
CROWD = 1_000


def pairs(items: DataFrame, id_col: str, vector_col: str, keys: list[str], threshold: float, group_col: str | None = None, parts: int | None = None) -> DataFrame:
    """(left_id, right_id, score) of items of one block whose score reaches threshold, left_id < right_id.

    Items of one group are no pair.  Blocks are split by the first two vector parts: two vectors
    closer than the threshold's distance differ by no more in any part.  Every item stands in its
    own cell and is looked for from the cells within that reach, only by items whose second part
    is not greater, so each pair is met once.  Of a cell with more than CROWD items every chunk
    meets every other as a key of its own: a hot cell (silence, say) is no single task.

    parts: length of all vectors, where it is known; they are then columns and their distance compiled code.
    """
    reach = max(1 / threshold - 1, 1e-9) * (1 + 1e-9)  # no pair is lost to rounding
    width = 2.001 * reach  # so an item is looked for from two cells a part at most
    group = F.col(group_col) if group_col else F.lit(None).cast("long")
    cell = lambda x: F.floor(x / width)
    base = items.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), group.alias("g"), *keys)
    base = base.withColumns({f"x{i}": F.get("v", F.lit(i)).cast("double") for i in range(max(2, parts or 0))})
    sent = [f"x{i}" for i in range(parts)] if parts else ["v", "x1"]
    at = F.xxhash64(*keys, "c0", "c1").alias("cell")
    home = base.withColumns({"c0": cell(F.col("x0")), "c1": cell(F.col("x1"))}).select("*", at)
    either = lambda x, y: F.explode(F.when(x == y, F.array(x)).otherwise(F.array(x, y)))
    seen = base.withColumn("c0", either(cell(F.col("x0") - reach), cell(F.col("x0") + reach))).withColumn("c1", either(cell(F.col("x1") - reach), cell(F.col("x1")))).select("*", at)
    crowded = small(home.groupBy("cell").count().where(F.col("count") > CROWD).select("cell", F.ceil(F.col("count") / CROWD).alias("n")))

    def chunked(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(crowded, "cell", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), "n").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).select("cell", "i", "j", *keys, "c0", "c1", "id", "g", *sent)

    names = ["cell", "i", "j", *keys, "c0", "c1"]
    left = chunked(home, "i", "j").toDF(*names, "a", "lg", *[f"l{x}" for x in sent])
    right = chunked(seen, "j", "i").toDF(*names, "b", "rg", *[f"r{x}" for x in sent])
    cond = [left[k].eqNullSafe(right[k]) if k in keys else left[k] == right[k] for k in names]
    cond += [left["a"] != right["b"], (left["lx1"] < right["rx1"]) | (left["lx1"].eqNullSafe(right["rx1"]) & (left["a"] < right["b"]))]
    if group_col:
        cond.append(~left["lg"].eqNullSafe(right["rg"]))
    if parts:
        gaps = [F.col(f"lx{i}") - F.col(f"rx{i}") for i in range(parts)]
        apart = F.sqrt(reduce(lambda total, x: total + x * x, gaps, F.lit(0.0)))
    else:
        apart = distance(F.col("lv"), F.col("rv"))
    return left.join(right, cond).select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), score(apart).alias("score")).where(F.col("score") >= threshold)


def components(edges: DataFrame, left: str = "left_id", right: str = "right_id", max_rounds: int = 60) -> DataFrame:
    """(id, component) with the smallest id of each connected component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): the number of
    rounds grows with the logarithm of the size, edges never grow, every round ends in a
    reliable checkpoint.  A hub's edges are spread by AQE's skew handling.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    nodes = e.select("u").union(e.select("v")).distinct()
    e = cut(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        small_min = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lows = small_min.groupBy("u").agg(F.min("v").alias("m"))
        small = small_min.join(lows, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").unionByName(lows.select(F.col("m").alias("a"), F.col("u").alias("b")))
        e = cut(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components not found within {max_rounds} rounds")
    labels = e.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return nodes.select(F.col("u").alias("id")).join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def feedback_key(left_file: Column, left_segment: Column, right_file: Column, right_segment: Column) -> list[Column]:
    """The pair in normal order; a whole file has segment -1."""
    a = F.struct(left_file.alias("file"), F.coalesce(left_segment, F.lit(-1)).alias("segment"))
    b = F.struct(right_file.alias("file"), F.coalesce(right_segment, F.lit(-1)).alias("segment"))
    return [F.least(a, b).alias("left"), F.greatest(a, b).alias("right")]


def with_feedback(found: DataFrame, feedback: DataFrame) -> DataFrame:
    """Pairs with the reviewers' state; 'rejected' pairs are left out."""
    state = feedback.select("left_id", "right_id", "state")
    return found.join(state, ["left_id", "right_id"], "left").where("state IS NULL OR state <> 'rejected'")


def descriptor_is_current(backend_version: str, parameters_hash: str, segment_method: str, max_duration_s: float | None) -> Column:
    """A stored descriptor (alias d) of a file (alias f) can be used again: no error, spectral features known, same file, method and parameters."""
    same_file = [F.col(f"d.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("size_bytes", "mtime", "md5")]
    wanted = {"backend_version": backend_version, "parameters_hash": parameters_hash, "segment_method": segment_method, "max_duration_s": max_duration_s}
    same_way = [F.col(f"d.{c}").eqNullSafe(F.lit(v)) for c, v in wanted.items()]
    known = [F.col(f"d.spectral_{c}").isNotNull() for c in ("centroid", "bandwidth", "rolloff", "flatness")]
    return reduce(lambda a, b: a & b, (*same_file, *same_way, *known), F.col("d.error").isNull())


def parameters_hash(parameters: dict) -> str:
    """A short name of a set of parameters: the same for the same values in any order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def to_describe(files: DataFrame, stored: DataFrame, current: Column, max_files: int | None = None, force: bool = False) -> DataFrame:
    """Readable files whose descriptor is missing or out of date, in the order of paths; at most max_files, where that is asked for."""
    f, d = files.where("scan_error IS NULL").alias("f"), stored.alias("d")
    fresh = d.join(f, F.col("d.file_id") == F.col("f.id")).where(F.lit(not force) & current).select(F.col("f.id").alias("id"))
    todo = files.where("scan_error IS NULL").join(fresh, "id", "left_anti")
    return todo if max_files is None else todo.orderBy("path").limit(max_files)


def crawl_counts(files: DataFrame, todo: DataFrame, described: DataFrame) -> DataFrame:
    """One row about a crawl: eligible, reused, described and failed files."""
    eligible = files.where("scan_error IS NULL").agg(F.count("*").alias("eligible"))
    asked = todo.agg(F.count("*").alias("asked"))
    done = described.agg(F.count_if(F.col("error").isNull()).alias("described"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    rows = eligible.crossJoin(asked).crossJoin(done)  # one row each
    return rows.select("eligible", (F.col("eligible") - F.col("asked")).alias("reused_or_left"), "described", "failed")


def cleared(feedback: DataFrame, pairs: DataFrame) -> DataFrame:
    """Feedback without the given pairs (left_file_id, right_file_id), whichever way round."""
    gone = pairs.select(F.least("left_file_id", "right_file_id").alias("_a"), F.greatest("left_file_id", "right_file_id").alias("_b")).distinct()
    keyed = feedback.withColumns({"_a": F.least("left_file_id", "right_file_id"), "_b": F.greatest("left_file_id", "right_file_id")})
    return keyed.join(gone, ["_a", "_b"], "left_anti").drop("_a", "_b")


def feedback_list(feedback: DataFrame, files: DataFrame, states: tuple[str, ...] = ()) -> DataFrame:
    """Decisions with the paths of both files, of the given states or of all; decisions on unknown files are left out."""
    rows = feedback.where(F.col("state").isin(*states)) if states else feedback
    of = lambda side: files.select(F.col("id").alias(f"{side}_file_id"), F.col("path").alias(f"{side}_path"))
    return rows.join(of("left"), "left_file_id").join(of("right"), "right_file_id")


def near_duplicates(found: DataFrame, items: DataFrame, id_col: str, hash_col: str | None = None) -> DataFrame:
    """(component, members, pairs, best_score, exact_pairs): groups of items linked by pairs.

    Pairs with equal known hashes are exact copies: they are counted, not linked.
    """
    rows = found
    if hash_col:
        h = items.select(F.col(id_col).alias("_i"), F.col(hash_col).alias("_h"))
        rows = rows.join(h.toDF("left_id", "_lh"), "left_id").join(h.toDF("right_id", "_rh"), "right_id").withColumn("exact", F.coalesce(F.col("_lh") == F.col("_rh"), F.lit(False)))
    else:
        rows = rows.withColumn("exact", F.lit(False))
    rows = cut(rows.select("left_id", "right_id", "score", "exact"))
    label = components(rows.where("NOT exact"))
    size = label.groupBy("component").agg(F.count("*").alias("members"))
    of_pair = rows.join(label.withColumnRenamed("id", "left_id"), "left_id").groupBy("component").agg(
        F.count_if(~F.col("exact")).alias("pairs"), F.max(F.when(~F.col("exact"), F.col("score"))).alias("best_score"), F.count_if("exact").alias("exact_pairs")
    )
    return size.join(of_pair, "component")


def random_page(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """n rows in an order drawn from the seed, the same for the same rows."""
    return df.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(n)
