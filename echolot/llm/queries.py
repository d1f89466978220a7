"""Queries of the training-data operators over the catalog's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canon, formatdup, leakage, lookalike, mixture, survivor, termfreq, topics, vecjoin
from .sql import SQL  # noqa: F401

# --- problem 1 -------------------------------------------------------------


def _hashed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with canonical md5 and folder rank; rows of size 0 and without a digest left out."""
    files = table(spark, sf_dir, "files").withColumn("digest", survivor.canonical_md5("md5"))
    files = files.where("digest IS NOT NULL AND (size_bytes IS NULL OR size_bytes <> 0)")
    return survivor.with_folder_rank(files, "path", table(spark, sf_dir, "preferred_folders"), "id")


def _file_bundles() -> list[survivor.Bundle]:
    scanned = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(scanned_at AS TIMESTAMP_NTZ))") / F.lit(1e6)
    possible = (F.col("mtime") >= F.lit(631152000.0)) & (F.col("mtime") <= scanned) & ~F.isnan("mtime")
    return [
        survivor.Bundle("path", ("path", "filename", "stem", "extension"), -F.col("folder_rank")),
        survivor.Bundle("mtime", ("mtime",), F.when(possible, F.col("mtime"))),
        survivor.Bundle("metadata_sources", ("metadata_sources",), survivor.source_count("metadata_sources")),
    ]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row each field of a set of copies is taken from."""
    chosen = survivor.surviving_rows(_hashed_files(spark, sf_dir), "digest", "id", _file_bundles())
    names = ("path", "mtime", "metadata_sources")
    rows = chosen.select(F.col("digest").alias("md5"), F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"{n}_id").alias("file_id")) for n in names])).alias("f"))
    return rows.select("md5", "f.field_name", "f.file_id").where("file_id IS NOT NULL")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per set of copies, built of consistent bundles.

    The audio fields are one bundle, taken from the row with the most of them known; a
    file extension determines the sample subtype that goes with it.
    """
    audio = ("sample_rate", "bit_depth", "channels", "duration_s", "subtype")
    known = sum((F.col(c).isNotNull().cast("int") for c in audio), F.lit(0))
    files = _hashed_files(spark, sf_dir).withColumn("suffix", F.lower("extension"))
    path, mtime, sources = _file_bundles()
    path = survivor.Bundle("path", path.fields, F.coalesce(path.trust, F.lit(-1_000_000)))  # a record needs a path
    bundles = [path, mtime, sources, survivor.Bundle("audio", audio, F.when(known > 0, known))]
    rules = [survivor.Dependency("path", "suffix", "audio", "subtype")]
    chosen = survivor.surviving_rows(files, "digest", "id", bundles, rules)
    fields = {b.name: b.fields for b in bundles}
    wide = files.select("id", *[c for cs in fields.values() for c in cs])
    picks = chosen.select("digest", "n_rows", "consistent", F.explode(F.array(*[F.struct(F.lit(b).alias("bundle"), F.col(f"{b}_id").alias("id")) for b in fields])).alias("p")).select("digest", "n_rows", "consistent", "p.*")
    rows = picks.join(wide, "id")
    # a bundle's fields come from one row, also where an id is stored twice with different content
    whole = rows.groupBy(F.col("digest").alias("md5")).agg(
        F.max("n_rows").alias("n_rows"), F.bool_and("consistent").alias("consistent"), *[F.max(F.when(F.col("bundle") == b, F.struct(*cs))).alias(f"_{b}") for b, cs in fields.items()]
    )
    return whole.select("md5", "n_rows", "consistent", *[F.col(f"_{b}")[c].alias(c) for b, cs in fields.items() for c in cs])


# --- problem 2 -------------------------------------------------------------


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose paths look the same but are not the same string."""
    return lookalike.lookalike_pairs(table(spark, sf_dir, "files"), "id", "path")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path and every filename in its consistent form, with the class of those that look like it."""
    files = table(spark, sf_dir, "files")
    both = [lookalike.lookalike_classes(files, "id", c).select(F.lit(c).alias("field"), "id", "consistent_form", "class_id", "spellings") for c in ("path", "filename")]
    return both[0].unionByName(both[1])


# --- problem 3 -------------------------------------------------------------


def _terms(spark: SparkSession, sf_dir: str, once: bool) -> tuple[DataFrame, DataFrame]:
    """Terms with their records, and the records of each kind; once: tags stored twice count as one occurrence, which needs a shuffle of them."""
    tags = table(spark, sf_dir, "accepted_tags")
    files = table(spark, sf_dir, "files")
    values = (tags.select("id", "file_id", "value").distinct() if once else tags).select(F.lit("value").alias("kind"), termfreq.value_term("value").alias("term"), F.col("file_id").alias("record"))
    words = files.select(F.lit("stem").alias("kind"), F.explode(termfreq.word_terms("stem")).alias("term"), F.col("id").alias("record"))
    totals = tags.agg(F.lit("value").alias("kind"), F.count_distinct("file_id").alias("total")).unionByName(
        files.agg(F.lit("stem").alias("kind"), F.count("stem").alias("total"))
    )
    return values.unionByName(words), totals


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of every term."""
    terms, totals = _terms(spark, sf_dir, True)
    return termfreq.marked(termfreq.term_counts(terms), totals).select(F.col("kind").alias("taken_from"), "term", "occurrences", "records", "mark")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in exactly one record or in at least 5 % of the records."""
    # marks go by records, which a tag stored twice does not change
    terms, totals = _terms(spark, sf_dir, False)
    return termfreq.marked(termfreq.term_counts(terms), totals).where("mark IS NOT NULL").select(F.col("kind").alias("taken_from"), "term", "mark")


# --- problem 4 -------------------------------------------------------------


def _ucs_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, entry): every way in which an entry may be named."""
    e = table(spark, sf_dir, "ucs_entries")
    sub = F.col("subcategory")
    pairs = [sub, F.col("cat_id"), *[F.concat_ws(" ", a, b) for c in ("category", "cat_short") for a, b in ((F.col(c), sub), (sub, F.col(c)))]]
    given = F.concat(F.array(*pairs), F.coalesce("synonyms", F.array().cast("array<string>")))
    return e.select(F.col("cat_id").alias("entry"), F.explode(given).alias("name")).where("entry IS NOT NULL")


def _subcategory_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "accepted_tags").select("id", "field", "value")
    return tags.where(formatdup.plain_text("field") == "ucssubcategory").withColumn("plain", canon.plain_form("value"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that each hand-typed subcategory tag means, or NONE."""
    tags = _subcategory_tags(spark, sf_dir).select(F.col("id").alias("tag_id"), "plain").distinct()
    meant = canon.mapped(tags, _ucs_names(spark, sf_dir))
    return tags.join(meant, "plain", "left").select("tag_id", F.coalesce("entry", F.lit(canon.NONE)).alias("cat_id"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry or several, with the number of tags that hold them."""
    tags = _subcategory_tags(spark, sf_dir).select(F.col("id").alias("tag_id"), "plain").distinct()
    meant = canon.mapped(tags, _ucs_names(spark, sf_dir)).where(F.col("entry") == canon.NONE)
    counts = tags.groupBy("plain").agg(F.count("*").alias("tags"))
    return counts.join(meant, "plain").select("plain", "tags", F.when(F.col("tier").isNotNull(), "several").otherwise("none").alias("reason"))


# --- problem 5 -------------------------------------------------------------


def _spectral() -> list:
    # a row whose four features are all zero, or one of which is negative infinity after the logarithm, is unusable
    log = [F.log(F.lit(1.0) + F.col(f"spectral_{c}")) / F.lit(10.0) for c in ("centroid", "bandwidth", "rolloff")]
    return [*log, F.col("spectral_flatness")]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of different files, each among the 5 nearest of the other, at most 0.0004 apart."""
    segments = table(spark, sf_dir, "audio_segments")
    found = vecjoin.nearest(segments, "id", _spectral(), 5, "file_id", max_distance=0.0004)
    return vecjoin.mutual(found).select("id_a", "id_b")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest segments of other files for every segment whose id is divisible by 20, searched among all."""
    segments = table(spark, sf_dir, "audio_segments")
    found = vecjoin.nearest(segments, "id", _spectral(), 5, "file_id", queries=F.col("id") % 20 == 0)
    return found.select("query", "neighbour", F.round("distance", 6).alias("distance"), "rank")


# --- problem 6 -------------------------------------------------------------


def _canonical_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "accepted_tags").select("id", "file_id", "field", "value")
    tags = tags.withColumn("field_c", formatdup.plain_text("field"))
    value = F.when(F.col("field_c") == "keyword", formatdup.plain_list("value")).otherwise(formatdup.plain_text("value"))
    return tags.withColumn("value_c", value)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further spellings of one tag of a file, each with the first."""
    return formatdup.copies(_canonical_tags(spark, sf_dir), ["file_id", "field_c", "value_c"], "id")


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per tag, as its first copy writes it, with the number of its copies."""
    return formatdup.collapsed(_canonical_tags(spark, sf_dir), ["file_id", "field_c", "value_c"], "id", ["file_id", "field", "value"])


# --- problem 7 -------------------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str, min_share: float | None = None) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage", min_share=min_share)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of a test item's passage."""
    return _leaks(spark, sf_dir).where("longest_run >= 12").select("doc_id", "item_id")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, partial and edited copies: a run of 12 words, or an alignment worth at least half the item."""
    return _leaks(spark, sf_dir, min_share=0.5).where("longest_run >= 12 OR share >= 0.5").select("doc_id", "item_id", "longest_run", "score", F.round("share", 4).alias("share"))


# --- problem 8 -------------------------------------------------------------


def _mixture_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    levels = {"source": mixture.plain_name("source"), "lang": F.coalesce(mixture.plain_name("lang"), F.lit("und"))}
    docs = mixture.counted(table(spark, sf_dir, "documents"), "doc_id", "text", levels)
    return docs, table(spark, sf_dir, "mix_targets").withColumn("source", mixture.plain_name("source"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, targets = _mixture_input(spark, sf_dir)
    return mixture.mixed(docs, "doc_id", ["source", "lang"], targets), docs, targets


def _filled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A mixture of as many tokens as all sources with a target hold, in which the languages of a source weigh alike: small languages and small sources are short."""
    docs, targets = _mixture_input(spark, sf_dir)
    wanted = docs.join(targets, "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0
    return mixture.mixed(docs, "doc_id", ["source", "lang"], targets, total_tokens=wanted, even=["lang"]), docs, targets


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mixture in which every source has its share, with their number of uses."""
    chosen, _, _ = _mixture(spark, sf_dir)
    return chosen.select("doc_id", "source", "lang", "tokens", "times")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    chosen, docs, targets = _mixture(spark, sf_dir)
    return mixture.shares(chosen, docs, targets, "source")


def p8_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in a mixture as large as all sources together: shortages go to sibling languages first, then to other sources."""
    chosen, docs, targets = _filled(spark, sf_dir)
    return mixture.shares(chosen, docs, targets, "source")


# --- problem 9 -------------------------------------------------------------


def _topics(spark: SparkSession, sf_dir: str, passes: int = topics.PASSES) -> topics.Fitted:
    return topics.fit(table(spark, sf_dir, "documents"), "doc_id", "text", mixture.plain_name("lang"), table(spark, sf_dir, "subject_examples"), passes)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the subjects that at least two of their sentences are about."""
    return topics.assigned(_topics(spark, sf_dir)).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean topic proportion by subject."""
    found = topics.assigned(_topics(spark, sf_dir)).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"), F.round(F.avg("proportion"), 4).alias("mean_proportion"))
    areas = table(spark, sf_dir, "subject_areas").select("subject")
    return areas.join(found, "subject", "left").na.fill(0, ["documents", "sentences"])


def p9_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top terms of each fitted topic and the subject it was mapped to by them, for inspection."""
    return topics.top_terms(_topics(spark, sf_dir), table(spark, sf_dir, "documents"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_records, p2_found, p2_forms, p3_found, p3_terms, p4_found, p4_unmatched, p5_found, p5_neighbours,
        p6_found, p6_collapsed, p7_found, p7_scores, p8_mixture, p8_shares, p8_filled, p9_found, p9_composition, p9_topics,
    )
}
