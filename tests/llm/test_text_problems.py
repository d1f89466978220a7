"""Look-alikes, term frequencies, canonical lists, formatting duplicates."""

import itertools
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolot.llm import canon, formatdup, lookalike, termfreq
from echolot.llm.textform import consistent, folded, lowered

TWINS = [
    ("РK0000\u200b306 Кlорfеn", "PK0000306 Klopfen"), ("ＡＢ　Ｃ", "AB C"), ("e\u0301", "é"), ("ﬁre", "fire"), ("a\u00a0b", "a b"), ("Тіе̂́ng", "Tiếng"),
    ("hear\u2011ing", "hear-ing"), ("Пoезд", "Поезд"), ("Gra\u00advel", "Gravel"), ("ガ", "ガ"), ("ΡΚ1", "PK1"),
]


@pytest.mark.parametrize("a,b", TWINS)
def test_look_alikes_get_one_form(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize("a,b", [("a", "A"), ("e", "é"), ("1", "l"), ("2", "²"), ("だ", "た"), ("/a", "\\a"), ("a b", "ab"), ("o", "0")])
def test_what_a_reader_can_tell_apart_stays_apart(a, b):
    assert consistent(a) != consistent(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_form_is_idempotent_and_stable_under_normalisation(text):
    once = consistent(text)
    assert consistent(once) == once
    assert consistent(unicodedata.normalize("NFC", text)) == consistent(unicodedata.normalize("NFD", text))
    assert folded(folded(text)) == folded(folded(folded(text)))


def test_column_agrees_with_function(spark):
    texts = [a for pair in TWINS for a in pair] + ["", None, "plain", "TAB\there", "x" * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r["id"]: r["f"] for r in lookalike.with_consistent_form(df, "text", "f").collect()}
    assert got == {i: None if t is None else consistent(t) for i, t in enumerate(texts)}


def test_lookalike_pairs_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([a for p in TWINS for a in p] + [None, ""])) for i in range(150)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "id long, path string, form string, id_a int")  # clashing names
    want = {(i, j) for (i, s), (j, t) in itertools.combinations(rows, 2) if s is not None and t is not None and s != t and consistent(s) == consistent(t)}
    pairs = [tuple(r) for r in lookalike.lookalike_pairs(df.unionByName(df.limit(60)), "id", "path").collect()]  # some rows twice
    assert set(pairs) == want and len(pairs) == len(want)
    classes = {r["id"]: r["class_id"] for r in lookalike.lookalike_classes(df, "id", "path").collect()}
    assert all(classes[i] == classes[j] for i, j in want) and len(classes) == sum(t is not None for _, t in rows)
    assert lookalike.lookalike_pairs(df.limit(0), "id", "path").count() == 0


def test_one_text_of_many_rows_makes_no_pairs(spark):
    """A text that a large share of the rows holds is paired once with each other text of its form, not row by row with itself."""
    hot = spark.range(60_000).select("id", F.lit("Same Path").alias("path"))
    few = spark.createDataFrame([(100_001, "Same\u00a0Path"), (100_002, "Ѕame Path"), (100_003, "other")], "id long, path string")
    pairs = lookalike.lookalike_pairs(hot.unionByName(few), "id", "path")
    assert pairs.count() == 2 * 60_000 + 1
    assert lookalike.lookalike_pairs(hot, "id", "path").count() == 0


def test_term_counts_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [("a", rng.choice(words), rng.choice([rng.randrange(100), rng.randrange(10**7), -5])) for _ in range(4000)]
    rows += [("b", "everywhere", i) for i in range(70_000)] + [("a", None, 1), ("a", "w1", None), (None, "w1", 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "kind string, term string, record long, chunk int").repartition(6)
    occ, docs = Counter(), defaultdict(set)
    for k, t, r in rows:
        if t is not None and r is not None:
            occ[k or "", t] += 1
            docs[k or "", t].add(r)
    got = {(r["kind"], r["term"]): (r["occurrences"], r["records"]) for r in termfreq.term_counts(df).collect()}
    assert got == {k: (occ[k], len(docs[k])) for k in occ}
    assert termfreq.term_counts(df.limit(0)).count() == 0


def test_container_union():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 65536, n)).astype(np.uint16) for n in (3, 50, 5000, 60000)]
    assert termfreq.union_size([termfreq.pack(s) for s in sets]) == len(set().union(*map(set, sets)))


def test_terms_and_marks(spark):
    df = spark.createDataFrame([(1, "  Ｒain \t Hit "), (2, "rain hit"), (3, " "), (4, None)], "id long, v string")
    assert [r[0] for r in df.orderBy("id").select(termfreq.value_term("v")).collect()] == ["rain hit", "rain hit", None, None]
    words = spark.createDataFrame([("SFX_Été take33-x_Door2b",)], "s string").select(termfreq.word_terms("s")).first()[0]
    assert words == ["sfx", "été", "take", "door"]
    counts = spark.createDataFrame([("v", "a", 1, 1), ("v", "b", 9, 5), ("v", "c", 3, 3)], "kind string, term string, occurrences long, records long")
    marks = termfreq.marked(counts, spark.createDataFrame([("v", 100)], "kind string, total long"))
    assert {r["term"]: r["mark"] for r in marks.collect()} == {"a": "rare", "b": "common", "c": None}


def osa_free(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, plainly."""
    da: dict[str, int] = {}
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, l, cost = da.get(b[j - 1], 0), db, 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1) if k and l else far)
        da[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=6))
def test_batched_distance_is_the_true_metric(name, queries):
    width = max(map(len, queries))
    codes = np.zeros((len(queries), width), dtype=np.int32)
    for i, q in enumerate(queries):
        codes[i, : len(q)] = list(map(ord, q))
    got = canon.edit_distances(name, codes, np.array([len(q) for q in queries]))
    assert got.tolist() == [osa_free(name, q) for q in queries]


def test_tree_finds_every_name_within_the_radius():
    rng = random.Random(2)
    names = ["".join(rng.choices("abcd", k=rng.randint(2, 8))) for _ in range(120)]
    queries = ["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(40)]
    radii = np.array([rng.randint(0, 3) for _ in queries])
    got = {(n, i, int(d)) for n, at, dist in canon.BKTree(names).within(queries, radii) for i, d in zip(at.tolist(), dist)}
    assert got == {(n, i, osa_free(n, q)) for n in set(names) for i, q in enumerate(queries) if osa_free(n, q) <= radii[i]}


NAMES = [("IMPACT", "w"), ("IMPACT", "m"), ("WOOD IMPACT", "w"), ("METAL IMPACT", "m"), ("Footsteps", "f"), ("dawn chorus", "s"), ("rollerblade", "r"), ("roller bed", "c"), ("DRIP", "d")]
CASES = {
    "footsteps": "f", "FООTSTEPS!": "f", "fotsteps": "f", "the Footsteps (new)": "f", "Foottttsteps": "f", "ftstps": "f", "footst.": "f", "impact": "NONE", "impact wood": "NONE",
    "wood: imapct": "w", "dwn chrs": "s", "dawnchorus 02": "s", "rollerb": "NONE", "newsletter": "NONE", "": "NONE", None: "NONE", "  ": "NONE", "drips": "d", "drxx": "NONE", "footsteps " * 40_000: "NONE",
}


@pytest.mark.parametrize("shards", [False, True])
def test_values_are_mapped(spark, shards, monkeypatch):
    if shards:
        monkeypatch.setattr(canon, "MAX_BROADCAST_NAMES", 4)
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(CASES)], "id long, value string, entry string").withColumn("plain", canon.plain_form("value"))
    meant = {r["plain"]: r["entry"] for r in canon.mapped(df, spark.createDataFrame(NAMES + [(None, "x"), ("y", None)], "name string, entry string")).collect()}
    got = {r["value"]: meant.get(r["plain"], "NONE") for r in df.collect()}
    assert got == CASES


def test_mapping_without_reference_or_values(spark):
    some = spark.createDataFrame([("rain",)], "plain string")
    none = spark.createDataFrame([], "name string, entry string")
    assert [r["entry"] for r in canon.mapped(some, none).collect()] == ["NONE"]
    assert canon.mapped(some.limit(0), none).count() == 0


def test_formatting_duplicates(spark):
    rows = [
        (1, 7, "keyword", "Rain, wind"), (2, 7, "Keyword:", "WIND;rain"), (2, 7, "Keyword:", "WIND;rain"), (3, 7, "title", "Rain, wind"), (4, 7, "title", "Wind, rain"), (5, 7, "title", "rain wind!"),
        (6, 7, "description", "at 9.5 m"), (7, 7, "description", "at 95 m"), (8, 7, "description", "AT 9.5 M."), (9, 8, "keyword", "Rain, wind"), (10, 7, "x", None), (11, 7, "x", None), (12, 7, "x", ""), (13, 7, "title", "Ｒain wind"),
    ]
    df = spark.createDataFrame([(*r, b"1", 0) for r in rows], "id long, file_id long, field string, value string, h binary, h2 int")
    c = df.withColumn("fc", formatdup.plain_text("field"))
    c = c.withColumn("vc", F.when(F.col("fc") == "keyword", formatdup.plain_list("value")).otherwise(formatdup.plain_text("value")))
    assert {tuple(r) for r in formatdup.copies(c, ["file_id", "fc", "vc"], "id").collect()} == {(1, 2), (3, 5), (3, 13), (6, 8), (10, 11)}
    sets = {r["first_id"]: (r["copies"], r["n_rows"]) for r in formatdup.collapsed(c, ["file_id", "fc", "vc"], "id").collect()}
    assert sets[1] == (2, 3) and sets[3] == (3, 3) and sets[12] == (1, 1)
    assert formatdup.copies(c.limit(0), ["file_id", "fc", "vc"], "id").count() == 0
    records = {r["first_id"]: (r["copies"], r["field"], r["value"]) for r in formatdup.collapsed(c, ["file_id", "fc", "vc"], "id", ["field", "value"]).collect()}
    assert records[1] == (2, "keyword", "Rain, wind") and records[10] == (2, "x", None)


def test_texts_that_meet_in_both_hashes_are_noticed(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    monkeypatch.setattr(formatdup.F, "md5", lambda c: F.lit("00"))
    assert formatdup.copies(df, ["v"], "id").count() == 0  # the second hash tells them apart
    monkeypatch.setattr(formatdup.F, "xxhash64", lambda *c: F.lit(0).cast("long"))
    with pytest.raises(Exception, match="two texts under one hash"):
        formatdup.copies(df, ["v"], "id").collect()


def test_hot_group_of_copies(spark):
    df = spark.range(30_000).select("id", F.lit("Same Text").alias("v")).unionByName(spark.range(30_000, 30_010).select("id", F.col("id").cast("string").alias("v")))
    got = formatdup.copies(df.withColumn("vc", formatdup.plain_text("v")), ["vc"], "id")
    assert got.count() == 29_999 and got.select("first_id").distinct().collect()[0][0] == 0


def test_lowered_keeps_accents_composed():
    assert lowered("E\u0301TÉ") == "été"


@pytest.mark.parametrize("bound", [50_000, 2])
def test_whole_name_among_other_words(spark, bound, monkeypatch):
    monkeypatch.setattr(canon, "MAX_BROADCAST_NAMES", bound)
    names = [("Metal", "METL"), ("Rain", "RAIN"), ("Heavy Rain", "RAINHvy"), ("Snow", "SNOW"), ("Wood", "WOODa"), ("wood", "WOODb")]
    want = {
        "some old metal": "METL", "rain take two": "RAIN", "very heavy rain outside": "RAINHvy", "rain or snow outside": canon.NONE, "old wood planks": canon.NONE,
        "metallic training sounds": canon.NONE, "unknown thing": canon.NONE,
    }
    values = spark.createDataFrame([(v,) for v in want], "plain string")
    assert {r["plain"]: r["entry"] for r in canon.mapped(values, spark.createDataFrame(names, "name string, entry string")).collect()} == want
