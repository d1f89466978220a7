"""Daily review: workbench, plans, checks, logs, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, layout, search, similarity, tags, workbench
from ..plans import snapshots
from ..session import table
from ..sources import scan
from . import content, tagging
from . import registry as R
from .registry import SQL, query

_F, _V = tagging._F, tagging._V
_STATUS = "CASE WHEN confidence < 0.6 OR confidence IS NULL THEN 'pending' WHEN confidence < 0.85 THEN 'approved' ELSE 'rejected' END"
_ENTRIES = f"""e AS (SELECT t.id AS entry_id, t.file_id, t.field, t.value, t.source, t.confidence, {_STATUS} AS status, 'add' AS action, f.path, f.filename, f.size_bytes, f.mtime, f.md5
    FROM (SELECT DISTINCT id, file_id, field, value, source, confidence FROM accepted_tags WHERE source IN ('filename', 'path', 'ucs_stem', 'synonym')) t LEFT JOIN files f ON f.id = t.file_id)"""
_HELD = f"x AS (SELECT DISTINCT file_id, {_F} AS f, {_V} AS v FROM accepted_tags WHERE source IN ('manual', 'sidecar') AND value IS NOT NULL AND trim(value) <> '')"
_LACK = f"{_ENTRIES}, {_HELD}, d AS (SELECT e.*, x.file_id IS NOT NULL AS dup FROM e LEFT JOIN x ON x.file_id = e.file_id AND x.f = {_F.replace('field', 'e.field')} AND x.v = {_V.replace('value', 'e.value')} WHERE trim(e.value) <> '')"


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Tags found in names and folders as entries of a plan."""
    rows = table(spark, sf, "accepted_tags").where(F.col("source").isin("filename", "path", "ucs_stem", "synonym")).select(F.col("id").alias("entry_id"), "file_id", "field", "value", "source", "confidence").distinct()
    status = F.when((F.col("confidence") < 0.6) | F.col("confidence").isNull(), "pending").when(F.col("confidence") < 0.85, "approved").otherwise("rejected")
    f = table(spark, sf, "files").select(F.col("id").alias("file_id"), "path", "filename", "size_bytes", "mtime", "md5")
    return rows.withColumns({"status": status, "action": F.lit("add")}).join(f, "file_id", "left")


def _held(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Tags set by hand, and those of sidecars in the place of embedded fields."""
    rows = table(spark, sf, "accepted_tags")
    embedded = rows.where("source = 'sidecar'").select("file_id", F.lit("tag").alias("namespace"), F.col("field").alias("key"), "value")
    return rows.where("source = 'manual'"), embedded


def _existing(spark: SparkSession, sf: str) -> DataFrame:
    return workbench.existing_values(*_held(spark, sf))


@query(f"WITH {_HELD} SELECT file_id, f AS field, v AS value_key FROM x")
def existing_values(spark: SparkSession, sf: str) -> DataFrame:
    """The values that files have already, by tags or embedded fields."""
    return _existing(spark, sf)


@query(f"WITH {_LACK} SELECT count(*) AS add_entries, count(*) FILTER (NOT dup) AS pending_entries, count(*) FILTER (dup) AS duplicate_entries, count(DISTINCT file_id) FILTER (NOT dup) AS files_with_pending FROM d")
def duplicate_aware_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A plan's additions less those that the files have already."""
    return workbench.duplicate_counts(_entries(spark, sf), _existing(spark, sf))


@query(f"""WITH {_ENTRIES}, p AS (SELECT DISTINCT file_id FROM e WHERE status = 'pending'), t AS (SELECT file_id, count(*) AS n FROM accepted_tags WHERE source = 'manual' GROUP BY ALL), m AS (SELECT file_id, count(*) AS n FROM accepted_tags WHERE source = 'sidecar' GROUP BY ALL),
    r AS (SELECT id, path, filename, coalesce(m.n, 0) AS embedded_fields, coalesce(t.n, 0) AS accepted_tags, CAST(CASE WHEN p.file_id IS NOT NULL THEN 0 WHEN t.n > 0 THEN 1 WHEN m.n > 0 THEN 2 ELSE 3 END AS INTEGER) AS rank
    FROM files LEFT JOIN p ON p.file_id = id LEFT JOIN t ON t.file_id = id LEFT JOIN m ON m.file_id = id WHERE contains(lower(filename), 'wav') OR contains(lower(path), 'wav'))
    SELECT * FROM r ORDER BY rank, path, id LIMIT 100 OFFSET 200""")
def workbench_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of the metadata workbench."""
    accepted, embedded = _held(spark, sf)
    pending = _entries(spark, sf).where("status = 'pending'").select("file_id")
    return workbench.workbench_rows(table(spark, sf, "files"), accepted, embedded, pending, "wav", 100, 200)


@query(f"""WITH {_LACK}, n AS (SELECT file_id, count(*) FILTER (status = 'pending') AS n_pending FROM d WHERE NOT dup GROUP BY file_id), p AS (SELECT * FROM n WHERE n_pending > 0 ORDER BY file_id LIMIT 50 OFFSET 50)
    SELECT d.file_id, n_pending, count(*) AS n_candidates, array_to_string(list_sort(list_distinct(list(source))), ', ') AS sources, array_to_string(list(field || '=' || value || ':' || status ORDER BY status <> 'pending', field, value, entry_id, status), '; ') AS shown
    FROM d JOIN p USING (file_id) WHERE NOT dup GROUP BY ALL""")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """A page of files with the proposed values they lack, open ones first."""
    rows = workbench.review_queue(_entries(spark, sf), _existing(spark, sf), 50, 50, pending_only=True)
    shown = F.array_join(F.transform("candidates", lambda c: F.concat(c["field"], F.lit("="), c["value"], F.lit(":"), c["status"])), "; ")
    return rows.select("file_id", "n_pending", "n_candidates", "sources", shown.alias("shown"))


@query(f"""WITH {_ENTRIES} SELECT field, value, source, count(*) AS n, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'pending') AS pending,
    min(confidence) AS least, max(confidence) AS greatest, coalesce(array_to_string(list_sort(list_distinct(list(filename)))[1:3], ', '), '') AS files FROM e GROUP BY field, value, source""")
def plan_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A plan by value, with confidences and sample files."""
    return workbench.plan_values(_entries(spark, sf))


@query(f"WITH {_ENTRIES}, b AS (SELECT source, field, CASE WHEN confidence < 0.5 THEN 'lo' WHEN confidence < 0.8 THEN 'mid' WHEN confidence IS NOT NULL THEN 'hi' END AS bucket FROM e) SELECT source, bucket, count(*) AS n FROM b GROUP BY ALL")
def suggestion_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed values by source and confidence bucket."""
    return _entries(spark, sf).groupBy("source", workbench.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


_DRIFTED = f"""{_ENTRIES}, q AS (SELECT entry_id, file_id, field, value, action, path, CASE WHEN field = 'title' THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, mtime, CASE WHEN source = 'path' THEN 'moved' ELSE md5 END AS md5 FROM e WHERE status = 'approved'),
    o AS (SELECT q.*, CASE WHEN f.id IS NULL THEN 'not_indexed' WHEN q.size_bytes <> f.size_bytes THEN 'size_changed' WHEN q.md5 <> f.md5 THEN 'content_changed' WHEN q.value IS NULL OR trim(q.value) = '' THEN 'skip' ELSE 'apply' END AS outcome FROM q LEFT JOIN files f ON f.id = q.file_id)"""


def _drifted(spark: SparkSession, sf: str) -> DataFrame:
    """The plan with files that changed since: titles by size, values of folders by content."""
    rows = _entries(spark, sf)
    return rows.withColumns({"size_bytes": F.when(F.col("field") == "title", F.col("size_bytes") + 1).otherwise(F.col("size_bytes")), "md5": F.when(F.col("source") == "path", "moved").otherwise(F.col("md5"))})


@query(f"WITH {_DRIFTED} SELECT entry_id, outcome FROM o")
def apply_log(spark: SparkSession, sf: str) -> DataFrame:
    """What applying a plan does with each approved entry."""
    return workbench.checked(_drifted(spark, sf), table(spark, sf, "files")).select("entry_id", "outcome")


@query(f"WITH {_DRIFTED} SELECT count(*) FILTER (outcome = 'apply') AS applied, count(*) FILTER (outcome = 'skip') AS skipped, count(*) FILTER (outcome NOT IN ('apply', 'skip')) AS failed FROM o")
def apply_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Applied, skipped and failed entries of a plan."""
    return workbench.outcome_counts(workbench.checked(_drifted(spark, sf), table(spark, sf, "files")))


@query(f"""WITH {_DRIFTED}, h AS (SELECT DISTINCT file_id, {_F} AS f, {_V} AS v FROM accepted_tags WHERE source = 'manual'),
    n AS (SELECT file_id, {_F} AS f, {_V} AS v, arg_min(value, entry_id) AS value, min(entry_id) AS plan_entry_id FROM o WHERE outcome = 'apply' GROUP BY ALL)
    SELECT n.file_id, n.f AS field, n.value, n.plan_entry_id FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file_id = n.file_id AND h.f = n.f AND h.v = n.v)""")
def apply_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The tags that a checked plan adds to those set by hand."""
    held = table(spark, sf, "accepted_tags").where("source = 'manual'").withColumn("plan_entry_id", F.lit(None).cast("long"))
    now = F.lit("2025-01-01").cast("timestamp_ntz")
    return workbench.apply_checked(held, _drifted(spark, sf), table(spark, sf, "files"), now)[0].where("plan_entry_id IS NOT NULL").select("file_id", "field", "value", "plan_entry_id")


@query(f"""WITH {_DRIFTED}, l AS (SELECT entry_id FROM o WHERE outcome = 'apply'), r AS (SELECT e.*, e.source = 'filename' AS yes, e.field = 'keyword' AS no, l.entry_id IS NOT NULL AS done FROM e LEFT JOIN l USING (entry_id))
    SELECT entry_id, CASE WHEN no AND done THEN status WHEN no THEN 'rejected' WHEN yes THEN 'approved' ELSE status END AS status, coalesce(no, false) AND done AS refused FROM r""")
def plan_review(spark: SparkSession, sf: str) -> DataFrame:
    """A review that approves a source and rejects a field; entries already applied cannot be rejected."""
    log = workbench.checked(_drifted(spark, sf), table(spark, sf, "files"))
    return workbench.review(_entries(spark, sf), F.col("source") == "filename", F.col("field") == "keyword", log).select("entry_id", "status", "refused")


@query(f"WITH {_ENTRIES}, g AS (SELECT DISTINCT file_id FROM e WHERE source = 'path') SELECT entry_id, CASE WHEN g.file_id IS NOT NULL AND status <> 'rejected' THEN 'approved' ELSE status END AS status FROM e LEFT JOIN g USING (file_id)")
def groups_approved(spark: SparkSession, sf: str) -> DataFrame:
    """All entries of some files approved, unless rejected."""
    rows = _entries(spark, sf)
    return workbench.approved_groups(rows, rows.where("source = 'path'"), "file_id").select("entry_id", "status")


@query(f"""WITH w AS ({SQL['embed_plan']}), h AS (SELECT file_id, 'tag' AS namespace, lower(field) AS key, min(value) AS found FROM accepted_tags WHERE source = 'sidecar' GROUP BY ALL)
    SELECT w.file_id, w.namespace, w.key, w.value, h.found, CASE WHEN h.found IS NULL THEN 'missing' WHEN h.found = w.value THEN 'match' ELSE 'differs' END AS state FROM w LEFT JOIN h USING (file_id, namespace, key) WHERE w.action IN ('add', 'replace', 'skip_same')""")
def write_readback(spark: SparkSession, sf: str) -> DataFrame:
    """What a write plan wanted against what is held now."""
    held = table(spark, sf, "accepted_tags").where("source = 'sidecar'").select("file_id", F.lit("tag").alias("namespace"), F.lower("field").alias("key"), "value")
    return workbench.readback(tagging.embed_plan(spark, sf), held)


@query(f"""WITH w AS ({SQL['embed_plan']}), p AS (SELECT file_id, count(*) FILTER (action IN ('add', 'replace')) AS n_writes, count(*) FILTER (action = 'conflict') AS n_conflicts FROM w GROUP BY file_id)
    SELECT file_id, n_writes, n_conflicts, CASE WHEN extension IS NULL THEN 'not_indexed' WHEN scan_error IS NOT NULL THEN 'unreadable' WHEN lower(extension) NOT IN ('.wav', '.bwf', 'wav', 'bwf') THEN 'unsupported' WHEN n_conflicts > 0 THEN 'conflict' WHEN n_writes = 0 THEN 'nothing_to_do' ELSE 'ready' END AS state
    FROM p LEFT JOIN files f ON f.id = p.file_id""")
def write_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Per file whether a write plan can be carried out."""
    return workbench.write_preview(tagging.embed_plan(spark, sf), table(spark, sf, "files"))


_RULE = R.key("r.folder")
_SAFE = f"""s AS (SELECT f.id, f.path, f.size_bytes, (SELECT arg_min(folder, (rule_order, folder)) FROM preferred_folders r WHERE r.folder IS NOT NULL AND ({R.key('f.path')} = {_RULE} OR starts_with({R.key('f.path')}, {_RULE} || '/') OR starts_with({_RULE}, {R.key('f.path')} || '/'))) AS protected_by FROM files f WHERE scan_error IS NOT NULL OR md5 IS NULL)"""


@query(f"WITH {_SAFE} SELECT id, path, size_bytes, CASE WHEN protected_by IS NULL THEN 'delete' ELSE 'protected' END AS state, protected_by FROM s")
def delete_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Unreadable and unhashed files put aside: what may go, and what a safe folder keeps."""
    return workbench.delete_plan(table(spark, sf, "files").where("scan_error IS NOT NULL OR md5 IS NULL"), table(spark, sf, "preferred_folders"))


@query(f"WITH {_SAFE} SELECT CASE WHEN protected_by IS NULL THEN 'delete' ELSE 'protected' END AS state, count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM s GROUP BY 1")
def delete_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes by state of the delete plan."""
    return workbench.state_summary(delete_plan(spark, sf))


@query(f"""WITH j AS (SELECT size_bytes, list_filter({R.ancestors('path').replace(R.key('path'), R.slashed('path'))}, lambda f: regexp_extract(f, '([^/]*)$', 1) IN ('_wfCache', '__MACOSX'))[1] AS folder FROM files)
    SELECT folder, count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM j WHERE folder IS NOT NULL GROUP BY folder""")
def junk_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Junk folders with what lies below them."""
    return audits.junk_folders(table(spark, sf, "files"))


@query(f"""WITH p AS ({SQL['tag_proposals']}) SELECT 'strength' AS dimension, strength AS key, count(*) AS n FROM p JOIN ucs_entries USING (cat_id) GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM p JOIN ucs_entries USING (cat_id) GROUP BY 2""")
def proposal_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals by strength and category."""
    return workbench.proposal_counts(tagging.tag_proposals(spark, sf), table(spark, sf, "ucs_entries"))


_OPENED = SQL["tag_proposals"][: SQL["tag_proposals"].index("o AS (SELECT * FROM h WHERE ")].rstrip().rstrip(",")
_OPENS = f"(ctx OR source = 'accepted_category' OR (n <= 3 AND word NOT IN ({tagging._BROAD})))"


@query(f"""{_OPENED}, g AS (SELECT source, word, max(n) AS catalog_matches, count(*) FILTER ({_OPENS}) AS opened, count(*) FILTER (NOT {_OPENS}) AS blocked FROM h GROUP BY source, word)
    SELECT * FROM (SELECT 'opened' AS kind, * FROM g WHERE opened > 0 ORDER BY opened DESC, catalog_matches DESC, source, word LIMIT 25) UNION ALL SELECT * FROM (SELECT 'blocked' AS kind, * FROM g WHERE blocked > 0 ORDER BY blocked DESC, catalog_matches DESC, source, word LIMIT 25)""")
def opening_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 words that open most catalog entries, and the 25 most often kept from it."""
    return tags.opening_diagnostics(tags.openings(table(spark, sf, "files"), table(spark, sf, "accepted_tags"), table(spark, sf, "ucs_entries"), tagging.ROOT))


@query("""WITH l AS (SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id)
    SELECT job_id, 'interrupted' AS status FROM l WHERE last = 'view'""")
def interrupted_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs (users) whose last event says that they still run (a view)."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"))
    return workbench.interrupted(e, F.lit("2025-01-01").cast("timestamp_ntz")).select("job_id", "status")


@query("""WITH r AS (SELECT coalesce(pack_key, '') AS artifact_id, text FROM documents), n AS (SELECT artifact_id, count(*) AS n_rows, max(CAST(contains(lower(text), '100%') AS INTEGER)) AS hit FROM r GROUP BY artifact_id),
    a AS (SELECT DISTINCT coalesce(pack_key, '') AS artifact_id, coalesce(pack_key, '') AS path, CASE WHEN pack_key LIKE 'PK00000%' THEN 'main' ELSE 'other' END AS kind FROM documents)
    SELECT artifact_id, path, kind, n_rows FROM a JOIN n USING (artifact_id) WHERE contains(lower(path), '100%') OR contains(lower(kind), '100%') OR hit = 1 OR contains(lower(path), 'pk00000') OR artifact_id IN (SELECT artifact_id FROM r WHERE contains(lower(text), 'pk00000'))""")
def artifact_list(spark: SparkSession, sf: str) -> DataFrame:
    """Packs with their documents, of which a word stands in the key or in a text; '%' is a plain character."""
    rows = table(spark, sf, "documents").select(F.coalesce("pack_key", F.lit("")).alias("artifact_id"), "text", "pack_key")
    kinds = rows.select("artifact_id", F.col("artifact_id").alias("path"), F.when(F.col("pack_key").startswith("PK00000"), "main").otherwise("other").alias("kind")).distinct()
    return workbench.artifact_list(kinds, rows, "100% PK00000")


@query("""SELECT 'file' AS kind, unnest(['path', 'filename', 'extension', 'md5', 'channels']) AS key, unnest([path, filename, extension, md5, CAST(channels AS VARCHAR)]) AS value FROM files WHERE id = 7
    UNION ALL SELECT DISTINCT 'tag', field, value FROM accepted_tags WHERE file_id = 7 UNION ALL SELECT DISTINCT 'segment', lpad(CAST(segment_index AS VARCHAR), 6, '0'), method FROM audio_segments WHERE file_id = 7""")
def file_detail(spark: SparkSession, sf: str) -> DataFrame:
    """One file with its tags and sound events."""
    return workbench.file_detail(table(spark, sf, "files"), table(spark, sf, "accepted_tags"), table(spark, sf, "audio_segments"), 7)


@query("SELECT s.id, s.file_id, segment_index, f.path AS file_path FROM audio_segments s JOIN files f ON f.id = s.file_id WHERE f.scan_error IS NULL")
def segments_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sound events with their readable file."""
    return workbench.segments_of_files(table(spark, sf, "files"), table(spark, sf, "audio_segments").drop("path")).select("id", "file_id", "segment_index", "file_path")


_ABBR = ", ".join(f"'{a}'" for a in tags.ABBREVIATIONS)
_FULL = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in tags.ABBREVIATIONS.items()) + "}"
_FLAT = "trim(regexp_replace(value, '[^\\p{L}\\p{M}\\p{N}'']+', ' ', 'g'))"
_KEPT = f"list_filter(string_split(flat, ' '), lambda w: NOT regexp_full_match(w, '\\p{{N}}*') AND (length(w) > 1 OR upper(w) IN ({_ABBR})))"
_TITLE = f"list_transform({_KEPT}, lambda w: coalesce({_FULL}[upper(w)], CASE WHEN regexp_matches(w, '[0-9]') AND upper(w) = w THEN w ELSE upper(w[1]) || lower(w[2:]) END))"


@query(f"""WITH d AS (SELECT DISTINCT field, value, {_F} AS f, {_FLAT} AS flat FROM accepted_tags)
    SELECT field, value, nullif(CASE WHEN f IN ('take_number', 'channel_position') THEN trim(regexp_replace(value, '[\\s\\x{{a0}}\\p{{Z}}]+', ' ', 'g')) WHEN f = 'keyword' THEN lower(array_to_string({_KEPT}, ' ')) WHEN f IN ('ucs_category', 'ucs_subcategory') THEN upper(flat)
    ELSE array_to_string({_TITLE}, ' ') END, '') AS clean FROM d""")
def clean_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values as their fields have them: capitals, small letters, titles, or as they are."""
    rows = table(spark, sf, "accepted_tags").select("field", "value").distinct()
    return rows.select("field", "value", workbench.clean_value(F.col("field"), F.col("value")).alias("clean"))


@query(f"""WITH st AS ({SQL['folder_stats']}), c AS ({SQL['folder_categories']}), k(number, vendor, series) AS (VALUES ('100', 'Known', 'First Series'), ('2020', 'Known', 'Year'))
    SELECT st.folder, CASE WHEN vendor IS NOT NULL THEN 'known_series' WHEN category IS NOT NULL THEN 'inferred_category' ELSE 'review' END AS action,
    CASE WHEN vendor IS NOT NULL THEN concat_ws('/', parent, vendor, series) WHEN category IS NOT NULL THEN concat_ws('/', parent, category, name) END AS target FROM st LEFT JOIN k ON k.number = st.name LEFT JOIN c ON c.folder = st.folder WHERE regexp_full_match(name, '[0-9]+')""")
def numeric_series(spark: SparkSession, sf: str) -> DataFrame:
    """Folders named by a number only and where they belong."""
    files = table(spark, sf, "files")
    known = spark.createDataFrame([("100", "Known", "First Series"), ("2020", "Known", "Year")], "number string, vendor string, series string")
    return layout.numeric_series(layout.folder_stats(files), layout.folder_categories(files), known)


@query(f"""WITH n AS ({SQL['folder_nesting']}), o AS (SELECT folder AS source, arg_min({{'kind': kind, 'target': target}}, CASE kind WHEN 'repeated_folder_name' THEN 0 WHEN 'low_value_wrapper' THEN 1 ELSE 2 END) AS x FROM n GROUP BY folder), d AS (SELECT len(string_split(source, '/')) AS depth, source, x.target AS target, x.kind AS kind FROM o)
    SELECT CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY depth ORDER BY source) AS INTEGER) AS step, source, target, kind FROM d""")
def nesting_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Folders that nest without need as a plan, numbered by depth."""
    stats = layout.folder_stats(table(spark, sf, "files"))
    return layout.nesting_plan(layout.nesting(stats), stats)


@query(f"WITH p AS ({SQL['rename_safe']}) SELECT id, CAST(len(string_split({R.slashed('source')}, '/')) AS INTEGER) AS depth, source, target FROM p WHERE status = 'planned'")
def rename_order(spark: SparkSession, sf: str) -> DataFrame:
    """Planned renames with their depth, the deepest first."""
    return layout.rename_order(layout.rename_plan(table(spark, sf, "files"), "safe")).select("id", "depth", "source", "target")


@query("SELECT path, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS n FROM files WHERE md5 IS NULL")
def dense_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Places in the order of paths, by ranges."""
    return scan.numbered(table(spark, sf, "files").where("md5 IS NULL").select("path"), "path", "n")


@query("""SELECT e.cat_id, q.word FROM (SELECT DISTINCT upper(trim(value)) AS word FROM accepted_tags WHERE value IS NOT NULL) q JOIN (SELECT word, arg_min(cat_id, (r, cat_id)) AS cat_id FROM (SELECT upper(trim(category)) AS word, cat_id, 0 AS r FROM ucs_entries UNION ALL SELECT upper(trim(cat_short)), cat_id, 1 FROM ucs_entries) GROUP BY word) e USING (word)""")
def category_or_short(spark: SparkSession, sf: str) -> DataFrame:
    """Values that name a category or its short form, with the first entry of either, the category first."""
    e = table(spark, sf, "ucs_entries")
    ways = [e.select(F.upper(F.trim(c)).alias("word"), F.struct(F.lit(r).alias("r"), F.col("cat_id").alias("cat_id")).alias("at")) for r, c in enumerate(("category", "cat_short"))]
    first = ways[0].unionByName(ways[1]).groupBy("word").agg(F.min("at.cat_id").alias("_any"), F.min("at").alias("at")).select("word", F.col("at.cat_id").alias("cat_id"))
    asked = table(spark, sf, "accepted_tags").where("value IS NOT NULL").select(F.upper(F.trim("value")).alias("word")).distinct()
    return asked.join(first, "word").select("cat_id", "word")


@query("""WITH c AS (SELECT id FROM files WHERE scan_error IS NULL), d AS (SELECT DISTINCT file_id FROM audio_segments s JOIN files f ON f.id = s.file_id WHERE f.path = s.path AND s.max_duration_s IS NOT DISTINCT FROM 30.0 AND spectral_centroid IS NOT NULL)
    SELECT (SELECT count(*) FROM c) AS eligible, (SELECT count(*) FROM c WHERE id IN (SELECT file_id FROM d)) AS reusable""")
def crawl_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """How many readable files have descriptors that can be used again (here: of the first seconds of the same path)."""
    files, seg = table(spark, sf, "files"), table(spark, sf, "audio_segments")
    current = (F.col("d.path") == F.col("f.path")) & F.col("d.max_duration_s").eqNullSafe(F.lit(30.0)) & F.col("d.spectral_centroid").isNotNull()
    todo = similarity.to_describe(files, seg, current)
    eligible = files.where("scan_error IS NULL").agg(F.count("*").alias("eligible"))
    return eligible.crossJoin(todo.agg(F.count("*").alias("_todo"))).select("eligible", (F.col("eligible") - F.col("_todo")).alias("reusable"))  # one row each
