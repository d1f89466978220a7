"""SQL for those of the queries that SQL can express."""

from __future__ import annotations

from . import textform

P1_FOUND = r"""
WITH f AS (
    SELECT *, regexp_replace(regexp_replace(lower(md5), '[\s\x{a0}{}"''\-]+', '', 'g'), '^md5[:=(]?', '') AS d,
        CASE WHEN regexp_matches(path, '^[A-Za-z]:') THEN lower(replace(path, '\', '/')) ELSE path END AS p
    FROM files WHERE size_bytes IS NULL OR size_bytes <> 0),
ok AS (
    SELECT *, list_filter(list_distinct(string_split_regex(regexp_replace(lower(metadata_sources), '[\[\]{}()"''\s\x{a0}]+', '', 'g'), '[,;|/]+')), lambda x: x NOT IN ('', 'null', 'none', 'nan')) AS names
    FROM f WHERE regexp_full_match(d, '[0-9a-f]{32}') AND d <> repeat(left(d, 1), 32) AND d <> 'd41d8cd98f00b204e9800998ecf8427e'),
sets AS (SELECT d FROM ok GROUP BY d HAVING count(DISTINCT id) > 1),
trust AS (
    SELECT o.d, o.id, 'path' AS field_name, (SELECT -min(rule_order) FROM preferred_folders r WHERE starts_with(o.p, CASE WHEN regexp_matches(r.folder, '^[A-Za-z]:') THEN lower(replace(r.folder, '\', '/')) ELSE r.folder END || '/'))::DOUBLE AS t
    FROM ok o SEMI JOIN sets USING (d)
    UNION ALL SELECT d, id, 'mtime', CASE WHEN mtime >= 631152000 AND mtime <= epoch_us(scanned_at) / 1e6 THEN mtime END FROM ok SEMI JOIN sets USING (d)
    UNION ALL SELECT d, id, 'metadata_sources', nullif(len(names), 0)::DOUBLE FROM ok SEMI JOIN sets USING (d))
SELECT d AS md5, field_name, id AS file_id FROM trust WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d, field_name ORDER BY t DESC, id) = 1
"""

_P5 = """p AS (SELECT DISTINCT id, file_id, ln(1 + spectral_centroid) / 10 AS a, ln(1 + spectral_bandwidth) / 10 AS b, ln(1 + spectral_rolloff) / 10 AS c, spectral_flatness AS d
    FROM audio_segments WHERE isfinite(spectral_centroid) AND isfinite(spectral_bandwidth) AND isfinite(spectral_rolloff) AND isfinite(spectral_flatness)
    AND NOT (spectral_centroid = 0 AND spectral_bandwidth = 0 AND spectral_rolloff = 0 AND spectral_flatness = 0)),
g AS (SELECT *, CAST(floor(a / 0.0004) AS BIGINT) AS ga, CAST(floor(b / 0.0004) AS BIGINT) AS gb FROM p),
s AS (SELECT * EXCLUDE (ga, gb), ga + unnest([-1, 0, 1]) AS ga, gb FROM g), s2 AS (SELECT * EXCLUDE (gb), gb + unnest([-1, 0, 1]) AS gb FROM s),
n AS (SELECT x.id AS q, y.id AS r, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2) AS dist
    FROM s2 x JOIN g y ON x.ga = y.ga AND x.gb = y.gb AND x.file_id IS DISTINCT FROM y.file_id),
k AS (SELECT q, r FROM n WHERE dist <= 0.0004 QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, r) <= 5)"""

P5_FOUND = f"WITH {_P5} SELECT u.q AS id_a, u.r AS id_b FROM k u JOIN k v ON u.q = v.r AND u.r = v.q WHERE u.q < u.r"

# p7: words after markup, character form, case and punctuation are put aside; 12 in a row of an item stand in a document
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_TWINS = {a: b for a, b in (textform._TWINS | textform.PUNCTUATION_TWINS).items()}


def _form(c: str) -> str:
    """The consistent form as far as the tables need it: composed, without ignorable characters, blanks, widths, ligatures and look-alikes as one."""
    blanks = f"regexp_replace({c}, '[\\x{{09}}-\\x{{0D}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
    seen = f"regexp_replace({blanks}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{FEFF}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
    quoted = "".join(_TWINS).replace("'", "''"), "".join(_TWINS.values()).replace("'", "''")
    narrow = f"translate({seen}, '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}')"
    for joined, apart in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("…", "...")):
        narrow = f"replace({narrow}, '{joined}', '{apart}')"
    return f"nfc_normalize(translate(nfc_normalize({narrow}), '{quoted[0]}', '{quoted[1]}'))"


def _plain(c: str) -> str:
    gone = f"regexp_replace({c}, '</?[A-Za-z][^<>]{{0,200}}>|&[A-Za-z]{{2,8}};|&#[0-9]{{1,6}};', ' ', 'g')"
    return f"regexp_extract_all(replace(lower({_form(gone)}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


def _grams(words: str) -> str:
    return f"unnest(list_distinct([array_to_string({words}[n : n + 11], ' ') for n in range(1, greatest(len({words}) - 10, 1))]))"


P7_FOUND = f"""
WITH d AS (SELECT doc_id, {_plain('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_plain('passage')} AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, {_grams('w')} AS g FROM d WHERE len(w) >= 12), ig AS (SELECT item_id, {_grams('w')} AS g FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

# p6: equal texts have equal forms; the forms themselves do not come out
def _bare(c: str) -> str:
    """Letters, marks and digits in small form; a point stays between two digits."""
    pointed = f"replace(lower({_form(c)}), 'ß', 'ss')"
    # the second time for digits that two points share
    for _ in range(2):
        pointed = f"regexp_replace({pointed}, '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"replace(regexp_replace({pointed}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x{{01}}]', '', 'g'), chr(1), '.')"


_PARTS = f"array_to_string(list_sort(list_filter(list_transform(string_split_regex(value, '[,;|/、，；]'), lambda x: {_bare('x')}), lambda x: x <> '')), ',')"
_P6 = f"""f AS (SELECT id, file_id, {_bare('field')} AS f, field, value FROM accepted_tags WHERE id IS NOT NULL),
c AS (SELECT DISTINCT id, file_id, f, CASE WHEN f = 'keyword' THEN {_PARTS} ELSE {_bare('value')} END AS v FROM f),
g AS (SELECT file_id, f, v, min(id) AS first_id, count(*) AS copies FROM c GROUP BY ALL)"""
P6_FOUND = f"WITH {_P6} SELECT g.first_id, c.id AS copy_id FROM c JOIN g ON c.file_id IS NOT DISTINCT FROM g.file_id AND c.f IS NOT DISTINCT FROM g.f AND c.v IS NOT DISTINCT FROM g.v WHERE c.id <> g.first_id"

# p5: every query against all rows
P5_NEIGHBOURS = f"""
WITH {_P5.split(', g AS')[0].split(chr(10) + 'g AS')[0].rstrip(',')},
q AS (SELECT * FROM p WHERE id % 20 = 0),
n AS (SELECT q.id AS query, p.id AS neighbour, sqrt((q.a - p.a) ** 2 + (q.b - p.b) ** 2 + (q.c - p.c) ** 2 + (q.d - p.d) ** 2) AS d FROM q JOIN p ON q.file_id IS DISTINCT FROM p.file_id AND q.id <> p.id),
k AS (SELECT query, neighbour, d, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM n)
SELECT query, neighbour, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5
"""

SQL = {"p1_found": P1_FOUND, "p5_found": P5_FOUND, "p5_neighbours": P5_NEIGHBOURS, "p7_found": P7_FOUND, "p6_found": P6_FOUND}
