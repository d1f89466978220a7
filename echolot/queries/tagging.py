"""Queries over tags: category stems, catalog, suggestions, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths, values
from ..operators import tags
from ..plans import snapshots
from ..session import small, table
from . import registry as R
from .registry import query

_UCS = "^([A-Z]{2,5})_([A-Z]{2,8})(?:_([\\s\\S]*)|$)"
ROOT = "/srv/sfx"


@query(f"SELECT id, regexp_matches(stem, '{_UCS}') AS is_ucs, nullif(regexp_extract(stem, '{_UCS}', 1), '') AS category, nullif(regexp_extract(stem, '{_UCS}', 2), '') AS subcategory, nullif(regexp_extract(stem, '{_UCS}', 3), '') AS remainder FROM files WHERE stem IS NOT NULL")
def ucs_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Stems parsed by category."""
    rows = table(spark, sf, "files").where("stem IS NOT NULL")
    return rows.select("id", names.ucs_parts(F.col("stem")).alias("u")).select("id", "u.*")


@query(f"""WITH s AS (SELECT id, regexp_extract(stem, '{_UCS}', 1) AS c, regexp_extract(stem, '{_UCS}', 2) AS b FROM files WHERE regexp_matches(stem, '{_UCS}'))
    SELECT c AS category, b AS subcategory, count(*) AS files, bool_or(e.cat_id IS NOT NULL) AS in_catalog FROM s LEFT JOIN (SELECT DISTINCT upper(trim(cat_short)) AS x, upper(trim(subcategory)) AS y, min(cat_id) AS cat_id FROM ucs_entries GROUP BY 1, 2) e ON c = x AND b = y GROUP BY ALL""")
def ucs_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Category pairs of the file names, checked against the catalog."""
    entries = table(spark, sf, "ucs_entries").select(F.upper(F.trim("cat_short")).alias("category"), F.upper(F.trim("subcategory")).alias("subcategory")).distinct().withColumn("hit", F.lit(True))
    rows = table(spark, sf, "files").select(names.ucs_parts(F.col("stem")).alias("u")).where("u.is_ucs").select("u.category", "u.subcategory")
    rows = rows.groupBy("category", "subcategory").agg(F.count("*").alias("files"))
    return rows.join(small(entries), ["category", "subcategory"], "left").select("category", "subcategory", "files", F.col("hit").isNotNull().alias("in_catalog"))


@query("SELECT category, count(*) AS entries, count(DISTINCT cat_short) AS codes, CAST(sum(len(synonyms)) AS BIGINT) AS synonyms, count(explanations) AS explained FROM ucs_entries GROUP BY category")
def ucs_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog entries by category."""
    e = table(spark, sf, "ucs_entries")
    return e.groupBy("category").agg(F.count("*").alias("entries"), F.count_distinct("cat_short").alias("codes"), F.sum(F.size("synonyms")).alias("synonyms"), F.count("explanations").alias("explained"))


@query("""WITH t AS (SELECT cat_id AS trigger_id, list_distinct(string_split(lower(s), ' ')) AS w FROM (SELECT cat_id, unnest(synonyms) AS s FROM ucs_entries) WHERE contains(s, ' ')),
    d AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT id, trigger_id FROM d, t WHERE list_has_all(d.w, t.w)""")
def token_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold all words of a synonym of several words."""
    texts = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), names.words(F.col("text")).alias("tokens"))
    syn = table(spark, sf, "ucs_entries").select("cat_id", F.explode("synonyms").alias("s")).where(F.contains("s", F.lit(" ")))
    triggers = syn.select(F.struct("cat_id", "s").alias("trigger_id"), F.split(F.lower("s"), " ").alias("tokens"))
    return tags.contained(texts, triggers).select("id", F.col("trigger_id.cat_id").alias("trigger_id")).distinct()


def _context(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files").where("scan_error IS NULL")


@query()
def tag_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """All suggestors, fused to one row per value."""
    stages = tags.suggestors(table(spark, sf, "ucs_entries"), ROOT)
    return tags.fused(tags.suggest(_context(spark, sf), stages))


@query()
def tag_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords from the catalog's synonyms for what the stems say."""
    catalog = table(spark, sf, "ucs_entries")
    pairs = catalog.select(F.lower("subcategory").alias("trigger"), F.explode("synonyms").alias("keyword")).distinct()
    return tags.from_synonyms(tags.from_ucs_stem(_context(spark, sf), catalog), pairs)


_LOW = ", ".join(f"'{w}'" for w in tags.LOW_VALUE_WORDS)
_BROAD = ", ".join(f"'{w}'" for w in tags.BROAD_WORDS)
_AF = "CASE lower(trim(field)) WHEN 'keywords' THEN 'keyword' WHEN 'genre' THEN 'category' WHEN 'ignr' THEN 'category' ELSE lower(trim(field)) END"


def _w(c: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_LOW}))"


_REL = f"CASE WHEN {R.key('path')} = '{ROOT}' OR starts_with({R.key('path')}, '{ROOT}/') THEN substr({R.slashed('path')}, {len(ROOT) + 2}) END"


@query(f"""WITH ok AS (SELECT * FROM files WHERE scan_error IS NULL), s AS (SELECT id AS file_id, 'filename' AS source, {_w("coalesce(stem, '')")} AS w FROM ok
    UNION ALL SELECT id, 'path', {_w(f"coalesce({R.parent(_REL)}, '')")} FROM ok
    UNION ALL SELECT file_id, source, list_distinct(flatten(list(w))) FROM (SELECT file_id, CASE WHEN {_AF} IN ('category', 'ucs_category') THEN 'accepted_category' ELSE 'accepted_semantic' END AS source, {_w('value')} AS w FROM accepted_tags WHERE value IS NOT NULL AND file_id IN (SELECT id FROM ok)) GROUP BY ALL),
    e AS (SELECT cat_id, {_w("category || ' ' || cat_short")} AS cat, unnest({_w('subcategory')}) AS word FROM ucs_entries), n AS (SELECT word, count(*) AS n FROM e GROUP BY word),
    u AS (SELECT file_id, source, w, unnest(w) AS word FROM s), h AS (SELECT file_id, source, cat_id, list_has_any(w, cat) AS ctx, n, word FROM u JOIN e USING (word) JOIN n USING (word)),
    o AS (SELECT * FROM h WHERE ctx OR source = 'accepted_category' OR (n <= 3 AND word NOT IN ({_BROAD}))), f AS (SELECT file_id, cat_id, list_sort(list_distinct(list(source))) AS so, bool_or(ctx) AS ctx FROM o GROUP BY ALL)
    SELECT file_id, cat_id, CASE WHEN list_contains(so, 'accepted_category') OR list_contains(so, 'accepted_semantic') OR (ctx AND list_contains(so, 'path')) THEN 'strong' WHEN ctx AND len(so) >= 2 THEN 'review' ELSE 'weak' END AS strength,
    CAST(CASE WHEN list_contains(so, 'accepted_category') OR list_contains(so, 'accepted_semantic') THEN 0.9 WHEN ctx AND list_contains(so, 'path') THEN 0.82 WHEN ctx AND len(so) >= 2 THEN 0.68 WHEN len(so) >= 2 THEN 0.5 ELSE 0.45 END AS DOUBLE) AS confidence,
    array_to_string(so, ',') AS sources FROM f WHERE len(so) > 1 OR NOT list_contains(so, 'filename') OR ctx""")
def tag_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog entries that names, folders and tags point to."""
    return tags.proposals(table(spark, sf, "files"), table(spark, sf, "accepted_tags"), table(spark, sf, "ucs_entries"), ROOT)


_F = "CASE lower(trim(field)) WHEN 'keywords' THEN 'keyword' WHEN 'genre' THEN 'category' ELSE lower(trim(field)) END"
_V = "lower(trim(regexp_replace(value, '[\\s\\x{a0}]+', ' ', 'g')))"
_R = "CASE source WHEN 'ucs_stem' THEN 60 WHEN 'ucs_catalog' THEN 50 WHEN 'group' THEN 40 WHEN 'path' THEN 30 WHEN 'filename' THEN 20 WHEN 'synonym' THEN 10 ELSE 0 END"


@query(f"""WITH t AS (SELECT DISTINCT file_id, {_F} AS field, {_V} AS k, {_R} AS r, coalesce(confidence, 0) AS c FROM accepted_tags WHERE {_V} <> ''),
    m AS (SELECT file_id, field, k, max({{'r': r, 'c': c}}) AS b FROM t GROUP BY ALL)
    SELECT file_id, field, k AS value_key, b.r AS rank, b.c AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY file_id, field, CASE WHEN field = 'keyword' THEN k ELSE '' END ORDER BY b DESC, k) = 1""")
def tag_fusion_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted tags fused as if they were suggestions."""
    rows = table(spark, sf, "accepted_tags").withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("evidence", F.array().cast("array<string>")).withColumn("ordinal", F.lit(0))
    won = tags.fused(rows.select("file_id", "field", "value", "source", "method", "confidence", "evidence", "ordinal"))
    return won.select("file_id", "field", values.value_key(F.col("value")).alias("value_key"), values.source_rank(F.col("source")).alias("rank"), "confidence")


_SLOT = f"CASE WHEN {_F} = 'keyword' THEN {_V} ELSE '' END"


_PLAN = f"""WITH e AS (SELECT DISTINCT id AS entry_id, file_id, {_F} AS field, value, {_SLOT} AS s FROM accepted_tags WHERE source = 'filename'), x AS (SELECT DISTINCT file_id, {_F} AS field, {_SLOT} AS s FROM accepted_tags WHERE source = 'manual' AND trim(value) <> '')
    SELECT entry_id, e.file_id, e.field, value, CASE WHEN x.file_id IS NOT NULL OR min(entry_id) OVER (PARTITION BY e.file_id, e.field, e.s) < entry_id THEN 'skip_existing' ELSE 'add' END AS action
    FROM e LEFT JOIN x ON x.file_id = e.file_id AND x.field = e.field AND x.s = e.s"""


@query(_PLAN)
def tag_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Tags from file names planned onto those set by hand."""
    rows = table(spark, sf, "accepted_tags")
    entries = rows.where("source = 'filename'").select(F.col("id").alias("entry_id"), "file_id", "field", "value").distinct()
    return tags.planned(entries, rows.where("source = 'manual'"))


@query(f"""WITH p AS ({_PLAN}), h AS (SELECT DISTINCT file_id, {_F} AS f, {_V} AS v FROM accepted_tags WHERE source = 'manual'),
    n AS (SELECT file_id, {_F} AS f, {_V} AS v, arg_min(value, entry_id) AS value, min(entry_id) AS plan_entry_id FROM p WHERE action = 'add' GROUP BY ALL)
    SELECT * FROM accepted_tags WHERE source = 'manual' UNION ALL BY NAME SELECT n.file_id, n.f AS field, n.value, n.plan_entry_id, TIMESTAMP '2025-01-01' AS created_at, TIMESTAMP '2025-01-01' AS updated_at
    FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file_id = n.file_id AND h.f = n.f AND h.v = n.v)""")
def tag_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The tags set by hand after the plan of ``tag_plan``."""
    held = table(spark, sf, "accepted_tags").where("source = 'manual'")
    return tags.applied(held, tag_plan(spark, sf), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT dimension, key, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS dimension, coalesce({c}, '') AS key FROM accepted_tags" for c in ("field", "source", "method")) + ") GROUP BY ALL")
def tag_plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tags by field, source and method in one pass."""
    return snapshots.plan_counts(table(spark, sf, "accepted_tags"), "field", "source", "method")


@query("SELECT field, source, count(*) AS n, min(confidence) AS low, max(confidence) AS high, grouping(field, source) AS level FROM accepted_tags GROUP BY GROUPING SETS ((field, source), (field), ())")
def tag_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence by field and source, by field, and over all."""
    table(spark, sf, "accepted_tags").createOrReplaceTempView("_tags")
    return spark.sql("SELECT field, source, count(*) AS n, min(confidence) AS low, max(confidence) AS high, grouping_id(field, source) AS level FROM _tags GROUP BY GROUPING SETS ((field, source), (field), ())")


@query(f"""WITH t AS (SELECT DISTINCT file_id, {_F} AS field, value FROM accepted_tags WHERE value IS NOT NULL) SELECT file_id, field, count(DISTINCT value) AS n_values FROM t WHERE field <> 'keyword' GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def tag_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Single-valued fields with several values."""
    rows = table(spark, sf, "accepted_tags").where("value IS NOT NULL").select("file_id", values.canonical_field(F.col("field")).alias("field"), "value").where("field <> 'keyword'")
    return rows.groupBy("file_id", "field").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


_PLACES = ", ".join(f"('{f}', '{n}', '{k}')" for f, ks in values.EMBEDDED_KEYS.items() for n, k in ks)


@query(f"""WITH k(field, namespace, key) AS (VALUES {_PLACES}), t AS (SELECT file_id, {_F} AS field, value, confidence FROM accepted_tags WHERE value IS NOT NULL),
    w AS (SELECT DISTINCT file_id, namespace, key, value FROM t JOIN k USING (field) WHERE confidence >= 0.2), c AS (SELECT file_id, namespace, key, count(DISTINCT value) > 1 AS bad FROM w GROUP BY ALL),
    h AS (SELECT file_id, namespace, key, min(value) AS existing FROM t JOIN k USING (field) WHERE confidence < 0.2 GROUP BY ALL)
    SELECT file_id, namespace, key, w.value, h.existing, CASE WHEN bad THEN 'conflict' WHEN h.existing = w.value THEN 'skip_same' WHEN h.existing IS NOT NULL THEN 'replace' ELSE 'add' END AS action
    FROM w JOIN c USING (file_id, namespace, key) LEFT JOIN h USING (file_id, namespace, key)""")
def embed_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted tags to be embedded, with tags of low confidence standing for what the files hold."""
    places = [(f, n, k) for f, ks in values.EMBEDDED_KEYS.items() for n, k in ks]
    keys = spark.createDataFrame(places, "field string, namespace string, key string")
    rows = table(spark, sf, "accepted_tags").where("value IS NOT NULL").withColumn("field", values.canonical_field(F.col("field")))
    held = rows.where("confidence < 0.2").join(small(keys), "field").select("file_id", "namespace", "key", "value")
    return snapshots.write_plan(rows.where("confidence >= 0.2"), held, keys)


@query(f"SELECT f.id, {R.parent('f.path')} AS folder, count(t.id) AS n FROM files f JOIN accepted_tags t ON t.file_id = f.id WHERE lower(trim(t.field)) = 'category' GROUP BY ALL")
def tagged_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Files with a category, by folder."""
    t = table(spark, sf, "accepted_tags").where(values.canonical_field(F.col("field")) == "category").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, sf, "files").join(t, "id").select("id", paths.parent("path").alias("folder"), "n")
