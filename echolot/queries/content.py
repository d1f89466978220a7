"""Queries over the file index: duplicates, audits, names, paths, series, packs, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import audits, duplicates, layout, packs, series
from ..session import table
from . import registry as R
from .registry import query

ROOT = "/srv/sfx"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "files")


_OK = "md5 IS NOT NULL AND scan_error IS NULL"


@query(f"""SELECT md5 AS hash, count(*) AS n_files, max(size_bytes) AS size_bytes, min(path) AS first_path,
    CAST(max(size_bytes) * (count(*) - 1) AS BIGINT) AS wasted_bytes FROM files WHERE {_OK} GROUP BY md5 HAVING count(*) > 1""")
def dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Contents held by several files."""
    return duplicates.groups(_files(spark, sf))


@query(f"SELECT md5 AS hash, id, path FROM files WHERE {_OK} AND md5 IN (SELECT md5 FROM files WHERE {_OK} GROUP BY md5 HAVING count(*) > 1)")
def dup_members(spark: SparkSession, sf: str) -> DataFrame:
    """Files of every group."""
    return duplicates.members(_files(spark, sf))


@query(f"""WITH g AS (SELECT md5 AS hash, count(*) AS n, max(size_bytes) * (count(*) - 1) AS w FROM files WHERE {_OK} GROUP BY md5 HAVING count(*) > 1)
    SELECT count(*) AS n_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_files, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_copies,
    CAST(coalesce(sum(w), 0) AS BIGINT) AS wasted_bytes, (SELECT hash FROM g ORDER BY coalesce(w, 0) DESC, hash LIMIT 1) AS largest FROM g""")
def dup_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Totals over all duplicate groups."""
    return duplicates.summary(_files(spark, sf))


_PROTECTED = f"""SELECT f.id, (SELECT p.folder FROM preferred_folders p WHERE {R.key('f.path')} = {R.key('p.folder')} OR starts_with({R.key('f.path')}, {R.key('p.folder')} || '/')
    ORDER BY rule_order, folder LIMIT 1) AS protected_by FROM files f"""


@query(_PROTECTED)
def protected_files(spark: SparkSession, sf: str) -> DataFrame:
    """The safe folder that protects each file."""
    return duplicates.protected(_files(spark, sf), table(spark, sf, "preferred_folders")).select("id", "protected_by")


@query(f"""WITH p AS ({_PROTECTED}), r AS (SELECT f.md5 AS hash, f.id, f.path, p.protected_by, row_number() OVER (PARTITION BY f.md5 ORDER BY CASE WHEN p.protected_by IS NOT NULL THEN 0 ELSE 1 END,
    coalesce(q.rule_order, 2147483647), CASE lower(f.extension) WHEN '.wav' THEN 1 WHEN '.aif' THEN 2 WHEN '.flac' THEN 3 ELSE 4 END, f.path, f.id) AS n, count(*) OVER (PARTITION BY f.md5) AS c
    FROM files f JOIN p ON p.id = f.id LEFT JOIN preferred_folders q ON q.folder = p.protected_by WHERE f.{_OK.replace('scan_error', 'f.scan_error')})
    SELECT hash, id, path, CAST(CASE WHEN n = 1 THEN 1 ELSE 2 END AS INTEGER) AS rank, CASE WHEN n = 1 THEN 'keep' WHEN protected_by IS NOT NULL THEN 'ignore' ELSE 'remove' END AS action FROM r WHERE c > 1""")
def dup_keep_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Which copy to keep and which to remove."""
    return duplicates.keep_plan(_files(spark, sf), table(spark, sf, "preferred_folders"))


@query("""WITH h AS (SELECT md5, count(*) AS n, min(path) AS p FROM files WHERE md5 IS NOT NULL AND is_ucs = 0 GROUP BY md5)
    SELECT f.id, coalesce(h.n, 0) AS matches, h.p AS first_match, CASE WHEN f.md5 IS NULL THEN 'unhashed' WHEN h.n IS NOT NULL THEN 'exists' ELSE 'new' END AS status
    FROM files f LEFT JOIN h ON f.md5 = h.md5 WHERE f.is_ucs = 1""")
def compare_import(spark: SparkSession, sf: str) -> DataFrame:
    """Category-named files as an import, compared by content with all others."""
    files = _files(spark, sf)
    return duplicates.compare(files.where("is_ucs = 1"), files.where("is_ucs = 0")).select("id", "matches", "first_match", "status")


_PW = "[" + ", ".join(f"'{w}'" for w in names.PROCESSED_WORDS) + "]"


@query(f"""WITH t AS (SELECT id, path, {R.parent('path')} AS folder, regexp_extract_all(lower(coalesce(stem, {R.stem('path')})), '[a-z0-9]+') AS w FROM files WHERE scan_error IS NULL),
    u AS (SELECT id, path, folder, list_sort(list_distinct(list_filter(w, lambda x: list_contains({_PW}, x)))) AS pw,
    array_to_string(list_filter(w, lambda x: NOT list_contains({_PW}, x) AND NOT regexp_full_match(x, '[0-9]+')), ' ') AS k FROM t),
    s AS (SELECT folder, k, max(path) AS src FROM u WHERE len(pw) = 0 AND k <> '' GROUP BY ALL)
    SELECT u.id, u.path, array_to_string(pw, ',') AS processed_words, s.src AS likely_source, CASE WHEN s.src IS NOT NULL THEN 'high' ELSE 'review' END AS confidence
    FROM u LEFT JOIN s ON u.folder = s.folder AND u.k = s.k WHERE len(pw) > 0""")
def processed_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered variants and their likely source."""
    return duplicates.processed(_files(spark, sf)).withColumn("processed_words", F.array_join("processed_words", ","))


_RATES = "sample_rate IS NOT NULL AND sample_rate NOT IN (44100, 48000, 88200, 96000, 176400, 192000)"


@query(f"""SELECT count(*) AS files, count(scan_error) AS scan_errors, count(*) FILTER (md5 IS NULL) AS unhashed, count(*) FILTER (sample_rate IS NULL) AS without_audio_info,
    {', '.join(f"count(*) FILTER ({f} = 1) AS with_{f[4:]}" for f in audits.FLAGS)}, count(*) FILTER (has_bext = 0 AND has_ixml = 0 AND has_riff_info = 0) AS without_metadata,
    count(*) FILTER (is_ucs = 1) AS ucs_named, count(*) FILTER ({_RATES}) AS unusual_rates, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes,
    round(coalesce(sum(duration_s), 0), 3) AS total_seconds FROM files""")
def library_audit(spark: SparkSession, sf: str) -> DataFrame:
    """All library counts in one pass."""
    return audits.library(_files(spark, sf))


@query("SELECT metric, key, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, CAST({c} AS VARCHAR) AS key FROM files" for c in ("sample_rate", "bit_depth", "channels", "subtype", "extension")) + ") WHERE key IS NOT NULL GROUP BY ALL")
def format_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Histograms of the format fields."""
    return audits.histogram(_files(spark, sf), "sample_rate", "bit_depth", "channels", "subtype", "extension")


@query(f"SELECT id, path, sample_rate FROM files WHERE {_RATES}")
def unusual_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Files with an unusual sample rate."""
    return _files(spark, sf).where(audits.unusual_rate()).select("id", "path", "sample_rate")


_RES = "(" + ", ".join(f"'{x}'" for x in paths.RESERVED_NAMES) + ")"


@query(f"""WITH c AS (SELECT id, unnest(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '')) AS component FROM files),
    d AS (SELECT * FROM c WHERE NOT regexp_matches(component, '^[A-Za-z]:$')),
    i AS (SELECT id, component, unnest([CASE WHEN component <> nfc_normalize(component) THEN 'unicode_normalization' END, CASE WHEN regexp_matches(component, '[:*?"<>|]') THEN 'illegal_chars' END,
    CASE WHEN upper(string_split(regexp_replace(component, '[ .]+$', ''), '.')[1]) IN {_RES} THEN 'windows_reserved_name' END, CASE WHEN regexp_matches(component, '[ .]$') THEN 'trailing_dot_or_space' END,
    CASE WHEN regexp_matches(component, '[#&;''\\\\!]') THEN 'risky_chars' END, CASE WHEN strlen(component) > 255 THEN 'name_too_long' END, CASE WHEN regexp_matches(component, '[^\\x00-\\x7f]') THEN 'non_ascii' END,
    CASE WHEN regexp_matches(component, '^\\s|\\s$') THEN 'leading_trailing_space' END, CASE WHEN starts_with(component, '.') AND component NOT IN ('.', '..') THEN 'dot_prefix' END]) AS issue FROM d)
    SELECT id, component, issue FROM i WHERE issue IS NOT NULL UNION ALL SELECT id, path, 'path_too_long' FROM files WHERE strlen(path) > 260""")
def name_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Broken name rules by path component."""
    return audits.name_issues(_files(spark, sf))


@query(f"""SELECT path, CASE WHEN regexp_matches(replace(path, '\\', '/'), '(^|/)(_wfCache|__MACOSX)(/|$)') THEN 'junk_folder' ELSE 'junk_file' END AS kind FROM files
    WHERE regexp_matches(replace(path, '\\', '/'), '(^|/)(_wfCache|__MACOSX)(/|$)') OR starts_with({R.base('path')}, '._') OR
    (lower({R.suffix(R.base('path'))}) NOT IN {names.AUDIO_SUFFIXES} AND ({R.base('path')} IN {names.JUNK_NAMES} OR lower({R.suffix(R.base('path'))}) IN {names.JUNK_SUFFIXES}))""")
def junk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Junk among the indexed paths."""
    return audits.junk(_files(spark, sf))


@query(f"SELECT id, {R.key('path')} AS path_key, {R.base('path')} AS base, {R.parent('path')} AS parent, {R.suffix(R.base('path'))} AS suffix, {R.stem('path')} AS stem FROM files")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and parts of every path."""
    p = F.col("path")
    return _files(spark, sf).select("id", paths.path_key(p).alias("path_key"), paths.basename(p).alias("base"), paths.parent(p).alias("parent"), paths.suffix(paths.basename(p)).alias("suffix"), paths.stem(p).alias("stem"))


@query(f"SELECT id, substr({R.slashed('path')}, 16) AS relative FROM files WHERE {R.key('path')} = 'd:/sfx/library' OR starts_with({R.key('path')}, 'd:/sfx/library/')")
def scope_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Files below a drive folder, however spelled."""
    root = F.lit("D:\\SFX\\Library\\")
    return _files(spark, sf).where(paths.in_scope("path", root)).select("id", paths.relative("path", root).alias("relative"))


@query(f"SELECT folder, count(*) AS n_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM (SELECT size_bytes, unnest({R.ancestors('path')}) AS folder FROM files) GROUP BY folder")
def ancestor_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes below every folder."""
    rows = _files(spark, sf).select("size_bytes", F.explode(paths.ancestors("path")).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query(f"""SELECT k AS collision_key, count(*) AS n_paths, min(path) AS first_path FROM (SELECT path, array_to_string(list_transform(string_split({R.key('path')}, '/'),
    lambda x: CASE WHEN x IN ('', '.') THEN x ELSE lower(regexp_replace(x, '[ .]+$', '')) END), '/') AS k FROM files) GROUP BY k HAVING count(*) > 1""")
def path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that fall together on a case-insensitive file system."""
    rows = _files(spark, sf).groupBy(paths.path_collision_key("path").alias("collision_key"))
    return rows.agg(F.count("*").alias("n_paths"), F.min("path").alias("first_path")).where("n_paths > 1")


_CH = "(?i)^(.*?)[\\s._-]+(l|r|left|right|mid|side|ms|mono|stereo|ortf|xy)$"
_NO = "(?i)^(.*?)(?:[\\s._-]*(?:take|tk))?[\\s._-]*?(\\d{1,4})$"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\-_.]+|[ \\-_.]+$', '', 'g')"


_MEMBERS = f"""SELECT *, lower(trim(regexp_replace(b, '[\\s._-]+', ' ', 'g'))) AS key FROM (
    SELECT id, path, stem, {R.parent('path')} AS parent, sample_rate, bit_depth, channels, CASE WHEN c THEN {_trim(f"regexp_extract(stem, '{_CH}', 1)")}
    ELSE {_trim(f"regexp_replace({_trim(f"regexp_extract(stem, '{_NO}', 1)")}, '(?i)[\\s._-]+(?:take|tk)$', '')")} END AS b,
    CASE WHEN c THEN upper(regexp_extract(stem, '{_CH}', 2)) ELSE regexp_extract(stem, '{_NO}', 2) END AS marker, CASE WHEN c THEN 'channel_set' ELSE 'numbered_sequence' END AS reason, c,
    regexp_matches(stem, '{_NO}') AS nu FROM (SELECT *, regexp_matches(stem, '{_CH}') AND length(regexp_replace({_trim(f"regexp_extract(stem, '{_CH}', 1)")}, '[^A-Za-z]', '', 'g')) >= 3 AS c
    FROM files WHERE scan_error IS NULL AND stem IS NOT NULL)) WHERE c OR (nu AND length(regexp_replace(b, '[^A-Za-z]', '', 'g')) >= 3)"""


@query(f"""WITH m AS ({_MEMBERS}), g AS (SELECT parent, key, reason, count(*) AS n_files, arg_min(stem, {{'p': path, 'i': id}}) AS shown_stem,
    list_sort(list_distinct(list(marker))) AS mk FROM m GROUP BY parent, key, reason HAVING count(*) >= 2)
    SELECT parent, key, reason, n_files, shown_stem, CAST(len(mk) AS INTEGER) AS n_markers, CASE WHEN (reason = 'channel_set' AND ((list_contains(mk, 'L') AND list_contains(mk, 'R')) OR (list_contains(mk, 'LEFT') AND list_contains(mk, 'RIGHT'))))
    OR (reason = 'numbered_sequence' AND len(list_distinct(list_transform(list_filter(mk, lambda x: regexp_full_match(x, '[0-9]+')), lambda x: CAST(x AS INTEGER)))) >= 3) THEN 'high' ELSE 'medium' END AS confidence FROM g""")
def related_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Series of takes and channels."""
    return series.groups(_files(spark, sf)).select("parent", "key", "reason", "n_files", "shown_stem", F.size("markers").alias("n_markers"), "confidence")


@query(f"""WITH m AS ({_MEMBERS}), g AS (SELECT parent, key, reason, count(*) AS n_files, count(DISTINCT sample_rate) > 1 AS a, count(DISTINCT bit_depth) > 1 AS b, count(DISTINCT channels) > 1 AS c
    FROM m GROUP BY parent, key, reason HAVING count(*) >= 2)
    SELECT parent, key, reason, n_files, array_to_string(list_filter([CASE WHEN a THEN 'sample_rate' END, CASE WHEN b THEN 'bit_depth' END, CASE WHEN c THEN 'channels' END], lambda x: x IS NOT NULL), ',') AS fields,
    CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) AS n_fields FROM g WHERE a OR b OR c""")
def format_inconsistency(spark: SparkSession, sf: str) -> DataFrame:
    """Series with several formats."""
    return series.inconsistent(_files(spark, sf)).withColumn("fields", F.array_join("fields", ","))


_PARTS = f"""SELECT folder, md5, count(*) AS n, max(size) AS size FROM (SELECT md5, coalesce(size_bytes, 0) AS size, unnest({R.ancestors('path')}) AS folder FROM files WHERE {_OK}) GROUP BY folder, md5"""
_FOLDERS = f"""p AS ({_PARTS}), f AS (SELECT folder, sum(n) AS n_files, count(*) AS n_contents, sum(size * n) AS bytes, array_to_string(list_sort(list(md5 || ':' || n)), ',') AS sig FROM p GROUP BY folder HAVING sum(n) >= 2),
    k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.sig = f.sig AND starts_with(g.folder, f.folder || '/')))"""


@query(f"WITH {_FOLDERS} SELECT folder, CAST(n_files AS BIGINT) AS n_files, n_contents, CAST(bytes AS BIGINT) AS bytes FROM k")
def pack_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folders as packs: only the deepest of those with one signature."""
    return packs.deepest(packs.folders(packs.contents(_files(spark, sf)))).drop("signature")


@query(f"WITH {_FOLDERS} SELECT min(folder) AS first_folder, count(*) AS n_folders, CAST(max(n_files) AS BIGINT) AS n_files, CAST(max(bytes) AS BIGINT) AS bytes, CAST(max(bytes) * (count(*) - 1) AS BIGINT) AS reclaimable FROM k GROUP BY sig HAVING count(*) > 1")
def pack_exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Folders with identical contents."""
    return packs.exact_groups(_files(spark, sf)).drop("signature")


@query(f"""WITH {_FOLDERS}, h AS (SELECT p.* FROM p JOIN k USING (folder)), s AS (SELECT md5 FROM h GROUP BY md5 HAVING count(*) BETWEEN 2 AND 25),
    o AS (SELECT DISTINCT a.folder AS l, b.folder AS r FROM h a JOIN h b ON a.md5 = b.md5 AND a.folder < b.folder JOIN s ON s.md5 = a.md5 WHERE NOT starts_with(a.folder, b.folder || '/') AND NOT starts_with(b.folder, a.folder || '/')),
    x AS (SELECT l, r, sum(least(a.n, b.n)) AS sf, sum(least(a.n, b.n) * least(a.size, b.size)) AS sb FROM o JOIN h a ON a.folder = l JOIN h b ON b.folder = r AND a.md5 = b.md5 GROUP BY l, r)
    SELECT l AS left_folder, r AS right_folder, CAST(sf AS BIGINT) AS shared_files, CAST(sb AS BIGINT) AS shared_bytes, round(sb / nullif(least(a.bytes, b.bytes), 0), 4) AS coverage,
    CASE WHEN sb / least(a.bytes, b.bytes) >= 0.95 THEN 'likely_duplicate_pack' ELSE 'overlapping_pack' END AS kind
    FROM x JOIN k a ON a.folder = l JOIN k b ON b.folder = r WHERE a.sig <> b.sig AND sb / nullif(least(a.bytes, b.bytes), 0) >= 0.05""")
def pack_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Folder pairs that share at least a twentieth of the smaller one."""
    return packs.overlaps(_files(spark, sf), threshold=0.05)


@query(f"""WITH {_FOLDERS}, h AS (SELECT p.* FROM p JOIN k USING (folder)), s AS (SELECT md5 FROM h GROUP BY md5 HAVING count(*) BETWEEN 2 AND 25),
    o AS (SELECT DISTINCT a.folder AS l, b.folder AS r FROM h a JOIN h b ON a.md5 = b.md5 AND a.folder < b.folder JOIN s ON s.md5 = a.md5 WHERE NOT starts_with(a.folder, b.folder || '/') AND NOT starts_with(b.folder, a.folder || '/')),
    x AS (SELECT l, r, sum(least(a.n, b.n) * least(a.size, b.size)) AS sb FROM o JOIN h a ON a.folder = l JOIN h b ON b.folder = r AND a.md5 = b.md5 GROUP BY l, r),
    y AS (SELECT l, r, sb / nullif(least(a.bytes, b.bytes), 0) AS c, a.bytes < b.bytes OR (a.bytes = b.bytes AND a.n_files < b.n_files) AS lg FROM x JOIN k a ON a.folder = l JOIN k b ON b.folder = r WHERE a.sig <> b.sig)
    SELECT CASE WHEN lg THEN l ELSE r END AS source, CASE WHEN lg THEN r ELSE l END AS target, round(c, 4) AS coverage, CASE WHEN round(c, 4) >= 1 THEN 'quarantine' ELSE 'review' END AS action FROM y WHERE c >= 0.5""")
def pack_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Which folder of an overlapping pair to give up."""
    files = _files(spark, sf)
    kept = packs.deepest(packs.folders(packs.contents(files)))
    return packs.plan(packs.overlaps(files, threshold=0.5), kept)


def _collision(c: str) -> str:
    return f"array_to_string(list_transform(string_split({R.key(c)}, '/'), lambda x: CASE WHEN x IN ('', '.') THEN x ELSE lower(regexp_replace(x, '[ .]+$', '')) END), '/')"


def _rename_sql(new: str) -> str:
    return f"""WITH b AS (SELECT id, path, {R.base('path')} AS old, nfc_normalize({R.base('path')}) AS n FROM files), r AS (SELECT id, path AS source, left(path, length(path) - length(old)) || new AS target FROM (SELECT *, {new} AS new FROM b) WHERE new <> old),
    k AS (SELECT *, {_collision('target')} AS ck FROM r), t AS (SELECT id, {_collision('path')} AS ck FROM files)
    SELECT id, source, target, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.ck = k.ck AND t.id <> k.id) OR min(id) OVER (PARTITION BY ck) < id THEN 'conflict' ELSE 'planned' END AS status FROM k"""


def _letters(c: str) -> str:
    """Letters whose capitals are several, written out (DuckDB's upper maps one to one)."""
    for a, b in (("ß", "SS"), ("ﬀ", "FF"), ("ﬁ", "FI"), ("ﬂ", "FL"), ("ﬃ", "FFI"), ("ﬄ", "FFL")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_SAFE = "regexp_replace(trim(regexp_replace(n, '[:*?\"<>|]+', '_', 'g')), '_+', '_', 'g')"
_UPPER = f"""regexp_replace(regexp_replace(regexp_replace({R.stem('n')}, '[:*?"<>|#&;''\\\\!]+', '_', 'g'), '[\\s\\-_]+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g')"""
_RENAMES = {
    "safe": _rename_sql(f"CASE WHEN {_SAFE} IN ('', '.', '..') THEN 'UNTITLED' ELSE {_SAFE} END"),
    "portable": None,
    "ucs": _rename_sql(f"CASE WHEN regexp_matches(upper({R.stem('n')}), '^([A-Z]{{2,5}})_([A-Z]{{2,8}})(?:_|$)') THEN '' ELSE 'SFX_MISC_' END || coalesce(nullif(upper({_letters(_UPPER)}), ''), 'UNTITLED') || lower({R.suffix('n')})"),
}


def _rename(style: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return layout.rename_plan(_files(spark, sf), style)

    run.__name__ = f"rename_{style}"
    run.__doc__ = f"Renames to the {style} style."
    return run


for _style, _sql in _RENAMES.items():
    query(_sql)(_rename(_style))


_ST = f"""a AS (SELECT {R.slashed('path')} AS p, path FROM files), b AS (SELECT unnest(list_filter(list_transform(range(1, greatest(len(string_split(p, '/')), 2)), lambda n: array_to_string(string_split(p, '/')[1:n], '/')), lambda x: x NOT IN ('', '/'))) AS folder,
    lower({R.suffix('path')}) IN {names.AUDIO_SUFFIXES} AS au FROM a), c AS (SELECT folder, count(*) FILTER (au) AS audio_files FROM b GROUP BY folder),
    d AS (SELECT {R.parent('p')} AS folder, count(*) AS direct_files FROM a GROUP BY ALL), e AS (SELECT {R.parent('folder')} AS folder, count(*) AS child_folders FROM c GROUP BY ALL),
    st AS (SELECT c.folder, {R.parent('c.folder')} AS parent, {R.base('c.folder')} AS name, coalesce(e.child_folders, 0) AS child_folders, coalesce(d.direct_files, 0) AS direct_files, c.audio_files
    FROM c LEFT JOIN d ON c.folder = d.folder LEFT JOIN e ON c.folder = e.folder)"""


@query(f"WITH {_ST} SELECT * FROM st")
def folder_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Folders with their children, files and audio below."""
    return layout.folder_stats(_files(spark, sf))


_FK = "lower(regexp_replace({}, '[\\s._-]+', ' ', 'g'))"
_EMPTY = tuple(layout.EMPTY_FOLDERS)


@query(f"""WITH {_ST}, o AS (SELECT parent AS folder, min(folder) AS child, min(name) AS child_name FROM st GROUP BY parent)
    SELECT st.folder, 'repeated_folder_name' AS kind, parent AS target FROM st WHERE audio_files > 0 AND {_FK.format('name')} = {_FK.format(R.base('parent'))}
    UNION ALL SELECT st.folder, 'single_child_chain', o.child FROM st JOIN o ON o.folder = st.folder WHERE audio_files > 0 AND direct_files = 0 AND child_folders = 1 AND lower(child_name) NOT IN {_EMPTY}
    UNION ALL SELECT folder, 'low_value_wrapper', parent FROM st WHERE audio_files > 0 AND child_folders = 0 AND lower(name) IN {layout.LEAF_WRAPPERS}""")
def folder_nesting(spark: SparkSession, sf: str) -> DataFrame:
    """Folders that nest without need."""
    return layout.nesting(layout.folder_stats(_files(spark, sf)))


@query(rf"""WITH {_ST}, p AS (SELECT folder, parent, name, regexp_extract(name, '^[A-Za-z][A-Za-z0-9]*') AS prefix FROM st), r AS (SELECT *, substr(name, length(prefix) + 1) AS rest FROM p),
    q AS (SELECT folder, parent, prefix, trim(rest, ' -_.+' || chr(9) || chr(10)) AS new_name FROM r WHERE length(prefix) >= 3 AND regexp_matches(rest, '^([\s_.-]|\+\+)')),
    z AS (SELECT *, lower(prefix) AS k FROM q WHERE new_name <> '' AND (regexp_matches(prefix, '^[A-Z]{{3,8}}$') OR regexp_matches(prefix, '[0-9]') OR regexp_matches(prefix, '^.+[A-Z]')))
    SELECT parent, min(prefix) OVER w AS prefix, folder, new_name FROM z WINDOW w AS (PARTITION BY parent, k) QUALIFY count(*) OVER w >= 3""")
def folder_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Sibling folders that begin with one code."""
    return layout.common_prefix(layout.folder_stats(_files(spark, sf)))


@query(rf"""WITH {_ST}, sn_w AS (SELECT folder, trim(name) AS w, substr(trim(name), 2, greatest(length(trim(name)) - 2, 0)) AS i FROM st),
    sn_b AS (SELECT folder, w, CASE WHEN left(w, 1) IN ('[', '(') AND right(w, 1) IN (']', ')') AND trim(i) <> '' AND NOT regexp_matches(i, '[\[\]()]') THEN trim(i) ELSE w END AS b FROM sn_w),
    sn_g AS (SELECT *, length(regexp_extract(b, '^[0-9]+')) AS n, regexp_extract(b, '^[0-9]+([\s\-_.]+)', 1) AS gap FROM sn_b),
    sn_c AS (SELECT folder, w, trim(CASE WHEN n > 0 AND gap <> '' AND ((n <= 3 AND (regexp_matches(gap, '[-_.]') OR length(gap) > 1)) OR n = 1 OR left(b, 1) = '0') THEN substr(b, n + length(gap) + 1) ELSE b END, ' -_.') AS new_name FROM sn_g)
    SELECT folder, new_name FROM sn_c WHERE new_name NOT IN ('', w) AND NOT regexp_full_match(new_name, '[0-9]+')""")
def folder_sort_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Folders whose names lose a sort number or brackets."""
    stats = layout.folder_stats(_files(spark, sf))
    return stats.select("folder", layout.without_sort_number(F.col("name")).alias("new_name")).where("new_name IS NOT NULL")


_DIR = f"left(path, length(path) - length({R.base('path')}))"
_ROOM = f"greatest(90 - strlen({_DIR}) - 7 - strlen({R.suffix(R.base('path'))}), 1)"
_STEM = R.stem("path")
_LONGEST = f"left({_STEM}, list_max(list_filter(range(0, length({_STEM}) + 1), lambda n: strlen(left({_STEM}, n)) <= {_ROOM})))"
_SHORT = f"regexp_replace({_LONGEST}, '[ \\-_.]+$', '')"


@query(f"SELECT id, {_DIR} || coalesce(nullif({_SHORT}, ''), left('SHORT', {_ROOM})) || '_' || left(md5({R.base('path')}), 6) || {R.suffix(R.base('path'))} AS short_path FROM files WHERE strlen(path) > 90")
def shortened_paths(spark: SparkSession, sf: str) -> DataFrame:
    """File paths of more than 90 bytes, shortened."""
    p = F.col("path")
    return _files(spark, sf).where(F.octet_length(p) > 90).select("id", layout.shortened(p, 90).alias("short_path"))


@query("""SELECT scan_error, CASE WHEN contains(scan_error, 'No ''data'' chunk marker') THEN 'riff_missing_data' WHEN contains(scan_error, 'Malformed ''fmt '' chunk') THEN 'riff_malformed_fmt'
    WHEN contains(scan_error, 'Format not recognised') THEN 'unknown_data' ELSE 'unknown' END AS class, count(*) AS n FROM files WHERE scan_error IS NOT NULL GROUP BY ALL""")
def scan_error_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of files that could not be read, by class (no bytes at hand)."""
    rows = _files(spark, sf).where("scan_error IS NOT NULL")
    return rows.groupBy("scan_error", names.scan_error_class(F.lit(b""), F.col("scan_error")).alias("class")).agg(F.count("*").alias("n"))


_CW = ", ".join(f"('{w}', '{c}')" for c, ws in layout.CATEGORY_WORDS.items() for w in ws)


@query(f"""WITH w(word, category) AS (VALUES {_CW}), f AS (SELECT {R.parent(R.slashed('path'))} AS folder, unnest(list_distinct(string_split_regex(lower(regexp_replace({R.stem('path')}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[\\s._-]+'))) AS word FROM files),
    s AS (SELECT folder, category, count(*) AS score FROM f JOIN w USING (word) WHERE folder IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER v AS n, lead(score) OVER v AS nxt FROM s WINDOW v AS (PARTITION BY folder ORDER BY score DESC, category DESC))
    SELECT folder, category, score FROM r WHERE n = 1 AND score >= 3 AND score >= coalesce(nxt, 0) + 2""")
def folder_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of folders by the words in their file names."""
    return layout.folder_categories(_files(spark, sf))


@query(f"""WITH g AS (SELECT count(*) - 1 AS extra, (count(*) - 1) * max(size_bytes) AS w FROM files WHERE {_OK} GROUP BY md5 HAVING count(*) > 1)
    SELECT (SELECT count(*) FROM files) AS files, (SELECT count(scan_error) FROM files) AS scan_errors, (SELECT CAST(coalesce(sum(extra), 0) AS BIGINT) FROM g) AS extra_copies, (SELECT CAST(coalesce(sum(w), 0) AS BIGINT) FROM g) AS wasted_bytes,
    (SELECT count(*) FROM accepted_tags) AS tags, (SELECT count(DISTINCT file_id) FROM accepted_tags) AS tagged_files""")
def audit_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """One row over several reports."""
    files = _files(spark, sf)
    parts = [audits.library(files).select("files", "scan_errors"), duplicates.summary(files).select("extra_copies", "wasted_bytes"), table(spark, sf, "accepted_tags").agg(F.count("*").alias("tags"), F.count_distinct("file_id").alias("tagged_files"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
