"""Queries by the filter language, views, text search, stored lists, snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dsl
from ..functions import names, values
from ..operators import audits, search
from ..plans import snapshots
from ..session import table
from ..sources import readers, schemas
from . import content  # noqa: F401  (its SQL is used here)
from .registry import SQL, query

_COLS = ", ".join(dsl.LISTED)


def _ls(name: str, text: str, where: str, sort: str = "path", order: str = "", limit: int = 0) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return dsl.listing(table(spark, sf, "files"), text, sort, limit)

    run.__name__, run.__doc__ = name, f"Listing for {text!r}."
    query(f"SELECT {_COLS} FROM files WHERE scan_error IS NULL AND ({where}) {order}")(run)


_ls("ls_range", "duration:2..10 rate:>=48000 -channels:1", "duration_s BETWEEN 2 AND 10 AND sample_rate >= 48000 AND NOT (channels = 1)")
_ls("ls_list", "depth:16,24 ext:wav,AIF", "bit_depth IN (16, 24) AND extension IN ('.wav', '.aif')")
_ls("ls_flags", "has:bext missing:ixml -has:riff_info", "has_bext = 1 AND (has_ixml IS NULL OR has_ixml = 0) AND NOT (has_riff_info = 1)")
_ls("ls_text", 'door "metal hit"', "(lower(path) LIKE '%door%' OR lower(filename) LIKE '%door%' OR lower(stem) LIKE '%door%') AND (lower(path) LIKE '%metal hit%' OR lower(filename) LIKE '%metal hit%' OR lower(stem) LIKE '%metal hit%')")
_ls("ls_largest", "ext:wav", "lower(extension) = '.wav'", "-size", "ORDER BY size_bytes DESC NULLS LAST, id LIMIT 100", 100)


@query("""WITH h AS (SELECT id, path, filename, CASE WHEN lower(filename) = 'door slam 06.wav' THEN 1 WHEN lower(stem) = 'door slam 06.wav' THEN 2 WHEN contains(lower(path), 'door slam 06.wav') THEN 3 END AS rank FROM files),
    k AS (SELECT * FROM h WHERE rank IS NOT NULL ORDER BY rank, path, id LIMIT 20), t AS (SELECT file_id, array_to_string(list_sort(list_distinct(list(CASE WHEN field IS NULL THEN value ELSE field || '=' || value END))), '; ') AS tags FROM accepted_tags WHERE value IS NOT NULL GROUP BY file_id)
    SELECT k.id, path, filename, CAST(rank AS INTEGER) AS rank, coalesce(t.tags, '') AS tags FROM k LEFT JOIN t ON t.file_id = k.id""")
def metadata_view(spark: SparkSession, sf: str) -> DataFrame:
    """Files by name with their tags."""
    return audits.metadata_view(table(spark, sf, "files"), table(spark, sf, "accepted_tags"), "Door Slam 06.wav")


_NI = f"ni AS ({SQL['name_issues']})"


@query(f"""WITH {_NI}, i AS (SELECT id, count(*) AS n FROM ni GROUP BY id) SELECT f.id, count(t.id) AS n_tags, count(DISTINCT t.field) AS n_fields, coalesce(any_value(i.n), 0) AS n_issues
    FROM files f LEFT JOIN accepted_tags t ON t.file_id = f.id LEFT JOIN i ON i.id = f.id GROUP BY f.id""")
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tags and fields per file."""
    files = table(spark, sf, "files")
    return audits.file_counts(files, table(spark, sf, "accepted_tags"), audits.name_issues(files)).select("id", "n_tags", "n_fields", "n_issues")


@query("""SELECT 'files' AS metric, count(*) AS value FROM files UNION ALL SELECT 'bytes', CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM files UNION ALL SELECT 'scan_errors', count(scan_error) FROM files
    UNION ALL SELECT 'unhashed', count(*) FILTER (md5 IS NULL) FROM files UNION ALL SELECT 'ucs_named', count(*) FILTER (is_ucs = 1) FROM files
    UNION ALL SELECT 'tags', count(*) FROM accepted_tags UNION ALL SELECT 'tagged_files', count(DISTINCT file_id) FROM accepted_tags""")
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the start page."""
    return audits.dashboard(table(spark, sf, "files"), table(spark, sf, "accepted_tags"))


@query("""SELECT unnest(list_filter([CASE WHEN scan_error IS NOT NULL THEN 'scan_errors' END, CASE WHEN md5 IS NULL AND scan_error IS NULL THEN 'unhashed' END, CASE WHEN has_bext = 0 AND has_ixml = 0 AND has_riff_info = 0 THEN 'missing_metadata' END,
    CASE WHEN sample_rate NOT IN (44100, 48000, 88200, 96000, 176400, 192000) THEN 'unusual_rate' END, CASE WHEN is_ucs = 0 THEN 'not_ucs' END, CASE WHEN channels <> 2 THEN 'mono_or_surround' END], lambda x: x IS NOT NULL)) AS queue, id FROM files""")
def review_queues(spark: SparkSession, sf: str) -> DataFrame:
    """Files in the queues that the file row alone decides; all_review_queues has the whole list."""
    return audits.file_queues(table(spark, sf, "files"))


@query(f"""WITH {_NI}, d AS (SELECT md5 FROM files WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) > 1)
    SELECT unnest(list_filter([CASE WHEN scan_error IS NOT NULL THEN 'scan_errors' END, CASE WHEN has_bext = 0 AND has_ixml = 0 THEN 'missing_metadata' END, CASE WHEN has_bext = 0 THEN 'missing_bext' END, CASE WHEN has_ixml = 0 THEN 'missing_ixml' END,
    CASE WHEN sample_rate NOT IN (44100, 48000, 88200, 96000, 176400, 192000) THEN 'unusual_rates' END, CASE WHEN is_ucs = 1 THEN 'ucs_named' END, CASE WHEN md5 IN (SELECT md5 FROM d) THEN 'duplicates' END], lambda x: x IS NOT NULL)) AS queue, id, 1::BIGINT AS n FROM files
    UNION ALL SELECT queue, id, count(*) FROM (SELECT unnest(list_filter(['filename_issues', CASE issue WHEN 'path_too_long' THEN 'long_paths' WHEN 'unicode_normalization' THEN 'unicode_normalization' END], lambda x: x IS NOT NULL)) AS queue, id FROM ni
    UNION ALL SELECT 'db_only_tags', t.file_id FROM accepted_tags t SEMI JOIN files f ON f.id = t.file_id) GROUP BY queue, id""")
def all_review_queues(spark: SparkSession, sf: str) -> DataFrame:
    """Files in all twelve review queues; decisions on similar files count where their table is stored."""
    files = table(spark, sf, "files")
    try:
        feedback = table(spark, sf, "similarity_feedback")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        feedback = spark.createDataFrame([], schemas.schema("similarity_feedback"))
    return audits.review_queues(files, audits.name_issues(files), table(spark, sf, "accepted_tags"), feedback)


@query("""SELECT id, path FROM files WHERE (contains(lower(path), 'rain') OR contains(lower(filename), 'rain')) AND (contains(lower(path), 'wav') OR contains(lower(filename), 'wav'))""")
def text_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every word in one of several columns."""
    return table(spark, sf, "files").where(audits.text_filter("Rain WAV", "path", "filename")).select("id", "path")


_TOK = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH d AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS term, len({_TOK.format('text')}) AS length FROM documents), p AS (SELECT term, id, count(*) AS tf, any_value(length) AS length FROM d GROUP BY term, id),
    s AS (SELECT count(*) AS n, avg(length) AS a FROM (SELECT id, any_value(length) AS length FROM p GROUP BY id)), f AS (SELECT term, count(*) AS df FROM p WHERE term IN ('thunder', 'lorry', 'clause') GROUP BY term)
    SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))), 6) AS score FROM p JOIN f USING (term), s GROUP BY id ORDER BY score DESC, id LIMIT 50""")
def search_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Best documents for three words."""
    docs = table(spark, sf, "documents")
    return search.bm25(docs, search.postings(docs, "doc_id", "text"), ["thunder", "lorry", "clause"]).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT id, ' ' || array_to_string({_TOK.format("concat_ws(' ', filename, stem)")}, ' ') || ' ' AS w FROM files)
    SELECT id FROM t WHERE (contains(w, ' door slam ') AND NOT contains(w, ' wav ')) OR contains(w, ' kettl')""")
def search_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Query syntax: phrase, NOT, OR, prefix."""
    return table(spark, sf, "files").where(search.matches(F.concat_ws(" ", "filename", "stem"), '"door slam" NOT wav OR kettl*')).select("id")


@query("""SELECT source, count(*) AS files FROM (SELECT DISTINCT id, lower(trim(unnest(CASE WHEN metadata_sources IS NULL OR trim(metadata_sources) IN ('', 'null') THEN []
    WHEN starts_with(trim(metadata_sources), '[') AND json_valid(metadata_sources) THEN CAST(metadata_sources::JSON AS VARCHAR[]) ELSE
    [CASE WHEN regexp_matches(trim(metadata_sources), '^".*"$') THEN regexp_replace(trim(metadata_sources), '^"|"$', '', 'g') ELSE metadata_sources END] END))) AS source FROM files) WHERE source <> '' GROUP BY source""")
def source_use(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata sources by number of files."""
    return audits.source_use(table(spark, sf, "files"))


@query("SELECT id, len(CASE WHEN evidence IS NULL OR trim(evidence) IN ('', 'null') THEN [] WHEN starts_with(trim(evidence), '[') AND json_valid(evidence) THEN list_filter(CAST(evidence::JSON AS VARCHAR[]), lambda x: x IS NOT NULL) ELSE [evidence] END) AS n FROM accepted_tags")
def evidence_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of lists stored as text, broken ones as lists of one."""
    return table(spark, sf, "accepted_tags").select("id", F.size(values.text_list(F.col("evidence"))).cast("long").alias("n"))


_OLD = "o_orderdate < TIMESTAMP '1997-01-01'"
_NEW = "o_orderdate >= TIMESTAMP '1996-06-01'"


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("at"))
    key = ["cust"]
    early = snapshots.latest(orders.where("at < TIMESTAMP_NTZ '1997-01-01 00:00:00'"), key, [F.col("at"), F.col("last_order")])
    late = snapshots.latest(orders.where("at >= TIMESTAMP_NTZ '1996-06-01 00:00:00'"), key, [F.col("at"), F.col("last_order")])
    return early, late


def _last(where: str) -> str:
    return f"SELECT o_custkey AS cust, o_orderkey AS last_order, o_totalprice AS price, o_orderdate AS at FROM orders WHERE {where} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


@query(f"WITH a AS ({_last(_OLD)}), b AS ({_last(_NEW)}) SELECT coalesce(b.cust, a.cust) AS cust, coalesce(b.last_order, a.last_order) AS last_order, coalesce(b.price, a.price) AS price, coalesce(a.at, b.at) AS at FROM a FULL JOIN b ON a.cust = b.cust")
def snapshot_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Latest order per customer, put into an older snapshot that keeps its time."""
    early, late = _snapshots(spark, sf)
    return snapshots.upsert(early, late, ["cust"], keep_old=["at"])


@query(f"WITH a AS ({_last(_OLD)}), b AS ({_last(_NEW)}) SELECT coalesce(b.cust, a.cust) AS cust, CASE WHEN a.cust IS NULL THEN 'registered' WHEN b.cust IS NULL THEN 'missing' WHEN a.last_order = b.last_order AND a.price = b.price THEN 'unchanged' ELSE 'updated' END AS status FROM a FULL JOIN b ON a.cust = b.cust")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between two snapshots."""
    early, late = _snapshots(spark, sf)
    return snapshots.difference(early, late, "cust", ["last_order", "price"])


@query(f"WITH a AS ({_last(_OLD)}), b AS ({_last(_NEW)}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE cust NOT IN (SELECT cust FROM a)")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of new keys added to a snapshot."""
    early, late = _snapshots(spark, sf)
    return snapshots.insert_or_ignore(early, late, ["cust"])


@query(f"WITH a AS ({_last(_OLD)}), b AS ({_last(_NEW)}) SELECT * FROM a WHERE cust NOT IN (SELECT cust FROM b) UNION ALL SELECT * FROM b")
def replaced_children(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of changed parents replaced."""
    early, late = _snapshots(spark, sf)
    return snapshots.replace_children(early, late, "cust", late)


@query("""WITH h AS (SELECT path, min(size_bytes) AS s, min(mtime) AS m, bool_and(sample_rate IS NOT NULL AND metadata_scanned_at IS NOT NULL AND md5 IS NOT NULL) AS ok FROM files WHERE is_ucs = 0 GROUP BY path)
    SELECT f.path, CASE WHEN h.ok IS NULL THEN 'new' WHEN h.s IS DISTINCT FROM f.size_bytes OR h.m IS DISTINCT FROM f.mtime THEN 'changed' WHEN NOT h.ok THEN 'incomplete' END AS reason
    FROM files f LEFT JOIN h ON f.path = h.path WHERE h.ok IS NULL OR NOT h.ok OR h.s IS DISTINCT FROM f.size_bytes OR h.m IS DISTINCT FROM f.mtime""")
def scan_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All paths as a listing against an index without the category-named files: what a full scan has to read."""
    files = table(spark, sf, "files")
    return snapshots.to_scan(files.select("path", "size_bytes", "mtime"), files.where("is_ucs = 0"), "full").select("path", "reason")


@query("""SELECT a.id AS file_id, CASE WHEN b.id IS NULL THEN 'not_indexed' WHEN a.path <> b.path THEN 'path_changed' WHEN a.size_bytes <> b.size_bytes THEN 'size_changed' WHEN abs(a.mtime - b.mtime) > 0.000001 THEN 'mtime_changed'
    WHEN a.md5 <> b.md5 THEN 'content_changed' END AS drift FROM files a LEFT JOIN files b ON b.id = a.id + 1""")
def plan_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Plan entries that no longer hold, for a plan that names each file's neighbour."""
    files = table(spark, sf, "files")
    plan = files.select((F.col("id") + 1).alias("file_id"), "path", "size_bytes", "mtime", "md5")
    return snapshots.drift(plan, files).select((F.col("file_id") - 1).alias("file_id"), "drift")


@query("""SELECT user_id AS job_id, event_type AS status, ts AS at, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """Latest event of each user as the state of a job."""
    log = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), "event_id")
    return snapshots.job_states(log)


@query("SELECT f.id, f.path, t.field, t.value, t.source, t.confidence FROM files f JOIN accepted_tags t ON t.file_id = f.id")
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Files with their tags as JSON, read back tag by tag."""
    rows = readers.export_rows(table(spark, sf, "files").select("id", "path", "filename"), table(spark, sf, "accepted_tags"))
    read = F.from_json("tags", "array<struct<field:string,value:string,source:string,confidence:double>>")
    return rows.select("id", "path", F.explode(read).alias("t")).select("id", "path", "t.*")


@query("SELECT count(*) AS n, count(md5) AS hashed FROM files")
def conformed_files(spark: SparkSession, sf: str) -> DataFrame:
    """The index brought to its fixed schema."""
    return schemas.conformed(table(spark, sf, "files"), "files").agg(F.count("*").alias("n"), F.count("md5").alias("hashed"))


@query("SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN format('{:.1f} KB', round(size_bytes / 1024, 1)) WHEN size_bytes < 1073741824 THEN format('{:.1f} MB', round(size_bytes / 1048576, 1)) ELSE format('{:.1f} GB', round(size_bytes / 1073741824, 1)) END AS size FROM files WHERE size_bytes IS NOT NULL")
def human_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes for readers."""
    return table(spark, sf, "files").where("size_bytes IS NOT NULL").select("id", names.human_bytes(F.col("size_bytes")).alias("size"))


@query(f"""WITH t AS (SELECT id, ' ' || array_to_string({_TOK.format("concat_ws(' ', filename, stem)")}, ' ') || ' ' AS w FROM files)
    SELECT id FROM t WHERE (contains(w, ' door ') AND contains(w, ' slam ') AND NOT contains(w, ' heavy ')) OR contains(w, ' kettl')""")
def search_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Query syntax answered from the inverted index: only the postings of the query's words are read."""
    files = table(spark, sf, "files")
    index = search.postings(files, "id", "filename", "stem")
    return search.find(files, "id", "door slam NOT heavy OR kettl*", "filename", "stem", index=index).select("id")


@query("""SELECT id FROM files WHERE contains(lower(filename), '"door') OR contains(lower(stem), '"door') OR contains(lower(path), '"door')""")
def search_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A query with an open quote is looked for as it stands."""
    return search.find(table(spark, sf, "files"), "id", '"door', "filename", "stem", "path").select("id")
