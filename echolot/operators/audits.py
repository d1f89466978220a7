"""Library audits: counts, histograms, file name health, metadata review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths, values

# Usual sample rates.
USUAL_RATES = (44100, 48000, 88200, 96000, 176400, 192000)
FLAGS = ("has_bext", "has_ixml", "has_riff_info", "has_adm", "has_cue_markers", "has_sampler")


def library(files: DataFrame) -> DataFrame:
    """All library counts in one pass, one row."""
    return files.agg(
        F.count("*").alias("files"), F.count_if(F.col("scan_error").isNotNull()).alias("scan_errors"), F.count_if(F.col("md5").isNull()).alias("unhashed"),
        F.count_if(F.col("sample_rate").isNull()).alias("without_audio_info"), *[F.count_if(F.col(f) == 1).alias(f"with_{f[4:]}") for f in FLAGS],
        F.count_if((F.col("has_bext") == 0) & (F.col("has_ixml") == 0) & (F.col("has_riff_info") == 0)).alias("without_metadata"), F.count_if(F.col("is_ucs") == 1).alias("ucs_named"),
        F.count_if(unusual_rate()).alias("unusual_rates"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 3).alias("total_seconds"),
    )


def unusual_rate(rate: str = "sample_rate") -> Column:
    return F.col(rate).isNotNull() & ~F.col(rate).isin(*USUAL_RATES)


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """(metric, key, n) for each column and value, NULLs left out: one pass by grouping sets in long form."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("key")) for c in columns])).alias("x"))
    return long.where("x.key IS NOT NULL").groupBy("x.metric", "x.key").agg(F.count("*").alias("n"))


def name_issues(files: DataFrame, root: str | None = None) -> DataFrame:
    """(id, component, issue): one row per path component and broken rule, for files below root (all without one).

    A path over 260 bytes is an issue of the whole path.
    """
    rows = files if root is None else files.where(paths.in_scope("path", F.lit(root)))
    inner = paths.relative("path", F.lit(root)) if root else F.translate(F.col("path"), "\\", "/")
    parts = rows.select("id", F.explode(F.filter(F.split(inner, "/"), lambda x: x != "")).alias("component"))
    parts = parts.where(~F.col("component").rlike("^[A-Za-z]:$"))
    found = parts.select("id", "component", F.explode(names.health_issues(F.col("component"), names.composed("component"))).alias("issue"))
    long = rows.where(F.octet_length("path") > 260).select("id", F.col("path").alias("component"), F.lit("path_too_long").alias("issue"))
    return found.unionByName(long)


def junk(paths_df: DataFrame, keep_ds_store: bool = False) -> DataFrame:
    """(path, kind): junk files, files inside junk folders."""
    kind = F.when(names.in_junk_folder(F.col("path")), "junk_folder").when(names.is_junk_file(F.col("path"), keep_ds_store), "junk_file")
    return paths_df.select("path", kind.alias("kind")).where("kind IS NOT NULL")


def source_use(files: DataFrame) -> DataFrame:
    """(source, files): how many files each metadata source was read from."""
    named = files.select("id", F.explode(F.array_distinct(F.transform(values.text_list(F.col("metadata_sources")), lambda x: F.lower(F.trim(x))))).alias("source"))
    return named.where("source <> ''").groupBy("source").agg(F.count("*").alias("files"))


def metadata_view(files: DataFrame, tags: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Files found by exact path, file name, stem or part of the path (in this order), with their tags as text."""
    q = query.lower()
    rank = F.when(F.col("path") == query, 0).when(F.lower("filename") == q, 1).when(F.lower("stem") == q, 2).when(F.contains(F.lower("path"), F.lit(q)), 3)
    hits = files.select("id", "path", "filename", rank.alias("rank")).where("rank IS NOT NULL").orderBy("rank", "path", "id").limit(limit)
    text = tags.where("value IS NOT NULL").groupBy(F.col("file_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "field", "value"))), "; ").alias("tags"))
    return hits.join(text, "id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def text_filter(text: str, *columns: str) -> Column:
    """Every word of text in at least one of the columns, whatever the case; no words: everything."""
    words = text.lower().split()
    one = [reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(w)) for c in columns]) for w in words]
    return F.coalesce(reduce(lambda a, b: a & b, one, F.lit(True)), F.lit(False))


def file_counts(files: DataFrame, tags: DataFrame, issues: DataFrame) -> DataFrame:
    """Per file the number of tags, of tag fields and of name issues (0 where none): each aggregated before it is joined."""
    t = tags.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n_tags"), F.count_distinct("field").alias("n_fields"))
    i = issues.groupBy("id").agg(F.count("*").alias("n_issues"))
    return files.select("id").join(t, "id", "left").join(i, "id", "left").na.fill(0, ["n_tags", "n_fields", "n_issues"])


def dashboard(files: DataFrame, tags: DataFrame) -> DataFrame:
    """(metric, value): the counts of the start page, each table read once."""
    counts = files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("scan_error").isNotNull()).alias("scan_errors"),
        F.count_if(F.col("md5").isNull()).alias("unhashed"), F.count_if(F.col("is_ucs") == 1).alias("ucs_named"),
    )
    tagged = tags.agg(F.count("*").alias("tags"), F.count_distinct("file_id").alias("tagged_files"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns])).alias("x")).select("x.*")

    return long(counts).unionByName(long(tagged))


def file_queues(files: DataFrame) -> DataFrame:
    """(queue, id): files waiting in the queues that the file row alone decides."""
    tests = {
        "scan_errors": F.col("scan_error").isNotNull(), "unhashed": F.col("md5").isNull() & F.col("scan_error").isNull(),
        "missing_metadata": (F.col("has_bext") == 0) & (F.col("has_ixml") == 0) & (F.col("has_riff_info") == 0), "unusual_rate": unusual_rate(),
        "not_ucs": F.col("is_ucs") == 0, "mono_or_surround": F.col("channels").isNotNull() & (F.col("channels") != 2),
    }
    return _queued(files, tests)


def _queued(files: DataFrame, tests: dict[str, Column]) -> DataFrame:
    return files.select("id", F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())).alias("queue")).select("queue", "id")


def review_queues(files: DataFrame, issues: DataFrame, tags: DataFrame, feedback: DataFrame) -> DataFrame:
    """(queue, id, n): files waiting in each of the twelve review queues, with the issues, tags or decisions they wait for (1 in other queues).

    Contents count as held twice whether or not a file could be read.  Tags and decisions
    on unknown files wait for nothing; a decision on two files is one of the left file.
    """
    tests = {
        "scan_errors": F.col("scan_error").isNotNull(), "missing_metadata": (F.col("has_bext") == 0) & (F.col("has_ixml") == 0), "missing_bext": F.col("has_bext") == 0,
        "missing_ixml": F.col("has_ixml") == 0, "unusual_rates": unusual_rate(), "ucs_named": F.col("is_ucs") == 1,
    }
    held = files.where(F.col("md5").isNotNull()).groupBy("md5").agg(F.count("*").alias("copies")).where("copies > 1").select("md5")
    single = _queued(files, tests).unionByName(files.join(held, "md5", "left_semi").select(F.lit("duplicates").alias("queue"), "id")).withColumn("n", F.lit(1).cast("long"))
    kinds = {"path_too_long": "long_paths", "unicode_normalization": "unicode_normalization"}
    named = F.array_compact(F.array(F.lit("filename_issues"), *[F.when(F.col("issue") == i, F.lit(q)) for i, q in kinds.items()]))
    known = files.select("id")
    tagged = tags.select(F.lit("db_only_tags").alias("queue"), F.col("file_id").alias("id")).join(known, "id", "left_semi")
    decided = feedback.select(F.lit("similarity_feedback").alias("queue"), F.col("left_file_id").alias("id"), "right_file_id").join(known, "id", "left_semi")
    decided = decided.join(known.select(F.col("id").alias("right_file_id")), "right_file_id", "left_semi").select("queue", "id")
    counted = issues.select(F.explode(named).alias("queue"), "id").unionByName(tagged).unionByName(decided).groupBy("queue", "id").agg(F.count("*").alias("n"))
    return single.unionByName(counted)


def junk_folders(files: DataFrame) -> DataFrame:
    """(folder, files, bytes): the outermost junk folders with all that lies below them."""
    inner = F.filter(paths.folders_above(paths.slashed("path")), lambda f: paths.basename(f).isin(*names.JUNK_FOLDERS))
    # folders come from the root down or from the file up: the outermost is the shortest
    outer = F.array_sort(F.transform(inner, lambda f: F.struct(F.length(f).alias("n"), f.alias("f"))))
    rows = files.select("size_bytes", F.get(outer, F.lit(0))["f"].alias("folder")).where("folder IS NOT NULL")
    return rows.groupBy("folder").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
