"""Catalog operators on literal tables."""

import datetime
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echolot.operators import audits, duplicates, layout, packs, search, series, similarity, tags
from echolot.plans import snapshots
from echolot.queries.catalog import QUERIES

FILES = "id long, path string, filename string, stem string, extension string, size_bytes long, md5 string, sample_rate int, bit_depth int, channels int, is_ucs int, scan_error string"


def files(spark, rows):
    out = []
    for i, (path, md5, *more) in enumerate(rows, 1):
        name = path.replace("\\", "/").rsplit("/", 1)[-1]
        stem, _, ext = name.rpartition(".")
        rate, depth, channels = (more + [48000, 24, 2])[:3] if not more else (more + [24, 2])[:3]
        out.append((i, path, name, stem, f".{ext}", 10, md5, rate, depth, channels, 0, None))
    return spark.createDataFrame(out, FILES)


def test_duplicates(spark):
    f = files(spark, [("/a/1.wav", "x"), ("/b/1.wav", "x"), ("/safe/1.mp3", "x"), ("/a/2.wav", "y"), ("/a/3.wav", None), ("/a/4.wav", None)])
    g = duplicates.groups(f).collect()
    assert [(r["hash"], r["n_files"], r["first_path"], r["wasted_bytes"]) for r in g] == [("x", 3, "/a/1.wav", 20)]
    rules = spark.createDataFrame([(1, "/safe")], "rule_order int, folder string")
    assert {r["path"]: r["action"] for r in duplicates.keep_plan(f, rules).collect()} == {"/safe/1.mp3": "keep", "/a/1.wav": "remove", "/b/1.wav": "remove"}
    assert duplicates.summary(f).first()["extra_copies"] == 2
    assert duplicates.summary(f.limit(0)).first()["n_groups"] == 0
    assert duplicates.members(f).count() == 3


def test_compare_and_processed(spark):
    f = files(spark, [("/a/Door.wav", "x"), ("/a/Door_EQ.wav", "y"), ("/b/Bell_wet 2.wav", None)])
    got = {r["path"]: (r["likely_source"], r["confidence"]) for r in duplicates.processed(f).collect()}
    assert got == {"/a/Door_EQ.wav": ("/a/Door.wav", "high"), "/b/Bell_wet 2.wav": (None, "review")}
    new = spark.createDataFrame([("n1", "x"), ("n2", "z"), ("n3", None)], "name string, md5 string")
    assert {r["name"]: (r["status"], r["first_match"]) for r in duplicates.compare(new, f).collect()} == {"n1": ("exists", "/a/Door.wav"), "n2": ("new", None), "n3": ("unhashed", None)}


def test_series(spark):
    rows = [(f"/m/Metal Hit {n}.wav", None, 48000 if n != "10" else 44100) for n in ("01", "02", "03", "10")] + [("/m/Wood Hit 01.wav", None), ("/m/Rain_L.wav", None), ("/m/Rain_R.wav", None)]
    f = files(spark, rows)
    got = {r["key"]: (r["n_files"], r["markers"], r["confidence"]) for r in series.groups(f).collect()}
    assert got == {"metal hit": (4, ["01", "02", "03", "10"], "high"), "rain": (2, ["L", "R"], "high")}
    assert [(r["key"], r["fields"]) for r in series.inconsistent(f).collect()] == [("metal hit", ["sample_rate"])]


def test_packs(spark):
    f = files(spark, [("C:\\Lib\\A\\1.wav", "p"), ("C:\\Lib\\A\\2.wav", "q"), ("c:/Lib/B/1.wav", "p"), ("c:/Lib/B/2.wav", "q"), ("/x/D/1.wav", "p"), ("/x/D/2.wav", "r"), ("/x/D/3.wav", None)])
    exact = packs.exact_groups(f).collect()
    assert [(r["first_folder"], r["n_folders"], r["reclaimable"]) for r in exact] == [("c:/lib/a", 2, 20)]
    got = {(r["left_folder"], r["right_folder"]): (r["shared_files"], r["coverage"]) for r in packs.overlaps(f, threshold=0.4).collect()}
    assert got[("/x/D", "c:/lib/a")] == (1, 0.5) and ("c:/lib/a", "c:/lib/b") not in got
    # a content in more folders than the cap opens no pair, but counts in one that another content opens
    many = files(spark, [(f"/m/f{i}/1.wav", "hot") for i in range(30)] + [(f"/m/f{i}/2.wav", f"own{i // 2}") for i in range(30)] + [(f"/m/f{i}/3.wav", f"only{i}") for i in range(30)])
    pairs = packs.overlaps(many, threshold=0.1).collect()
    assert len(pairs) == 15 and {r["shared_files"] for r in pairs} == {2}


def test_name_issues_and_audit(spark):
    f = files(spark, [("/lib/cafe\u0301/bad!name.wav", None), ("/lib/ok/x.wav", "h")])
    got = {(r["id"], r["component"], r["issue"]) for r in audits.name_issues(f, "/lib").collect()}
    assert got == {(1, "cafe\u0301", "unicode_normalization"), (1, "cafe\u0301", "non_ascii"), (1, "bad!name.wav", "risky_chars")}
    assert {(r["metric"], r["key"], r["n"]) for r in audits.histogram(f, "sample_rate", "md5").collect()} == {("sample_rate", "48000", 2), ("md5", "h", 1)}
    found = spark.createDataFrame([("/a/_wfCache/x.wav",), ("/a/._b.wav",), ("/a/b.wav",)], "path string")
    assert {r["path"]: r["kind"] for r in audits.junk(found).collect()} == {"/a/_wfCache/x.wav": "junk_folder", "/a/._b.wav": "junk_file"}


def test_all_review_queues(spark, tmp_path):
    long = "/lib/" + "x" * 130 + "/" + "y" * 130 + ".wav"
    cols = "id long, path string, md5 string, sample_rate int, has_bext int, has_ixml int, has_riff_info int, is_ucs int, channels int, scan_error string"
    rows = [
        (1, "/lib/a.wav", "x", 48000, 1, 1, 0, 0, 2, None), (2, "/lib/b.wav", "x", 22050, 0, 0, 1, 1, 1, "broken"), (3, "/lib/cafe\u0301!.wav", None, None, 0, 1, 1, 0, 2, None),
        (4, long, "y", 44100, 1, 0, 0, None, 2, None), (5, "/lib/c.wav", None, 48000, None, None, None, None, 2, None),
    ]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([(1, "category"), (1, "keyword"), (9, "keyword")], "file_id long, field string").write.parquet(f"{tmp_path}/accepted_tags.parquet")
    want = {
        ("scan_errors", 2, 1), ("duplicates", 1, 1), ("duplicates", 2, 1), ("missing_metadata", 2, 1), ("missing_bext", 2, 1), ("missing_bext", 3, 1), ("missing_ixml", 2, 1), ("missing_ixml", 4, 1),
        ("unusual_rates", 2, 1), ("ucs_named", 2, 1), ("filename_issues", 3, 3), ("unicode_normalization", 3, 1), ("filename_issues", 4, 1), ("long_paths", 4, 1), ("db_only_tags", 1, 2),
    }
    got = lambda: sorted((r["queue"], r["id"], r["n"]) for r in QUERIES["all_review_queues"](spark, str(tmp_path)).collect())
    assert got() == sorted(want)
    spark.createDataFrame([(3, 1, "accepted"), (3, 4, "rejected"), (9, 1, "hidden"), (1, 9, "hidden")], "left_file_id long, right_file_id long, state string").write.parquet(f"{tmp_path}/similarity_feedback.parquet")
    assert got() == sorted(want | {("similarity_feedback", 3, 2)})


def test_tagged_folders_know_other_names_of_category(spark, tmp_path):
    spark.createDataFrame([(i, f"/lib/{i}.wav") for i in range(1, 5)], "id long, path string").write.parquet(f"{tmp_path}/files.parquet")
    tags = [(1, "category"), (1, " Genre"), (2, "IGNR"), (3, "subcategory"), (4, None)]
    spark.createDataFrame(tags, "file_id long, field string").write.parquet(f"{tmp_path}/accepted_tags.parquet")
    assert sorted(tuple(r) for r in QUERIES["tagged_folders"](spark, str(tmp_path)).collect()) == [(1, "/lib", 2), (2, "/lib", 1)]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in similarity.components(spark.createDataFrame(edges, "left_id long, right_id long")).collect()}
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert got == want
    assert similarity.components(spark.createDataFrame([], "left_id long, right_id long")).count() == 0


def test_blocked_pairs_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), i % 7, [rng.random() for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, g int, v array<double>")
    score = lambda a, b: 1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5)
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and a[2] != b[2] and score(a[3], b[3]) >= 0.8}
    assert {(r["left_id"], r["right_id"]) for r in similarity.pairs(df, "id", "v", ["k"], 0.8, "g").collect()} == want


def test_pairs_of_a_crowded_cell_are_spread(spark, monkeypatch):
    """Silent items, all alike, are met by many tasks, and every pair comes out once."""
    monkeypatch.setattr(similarity, "CROWD", 50, raising=False)
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as for a large table
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        silent = [(n, n // 2, "x", [0.0, 0.0, 0.0]) for n in range(600)]
        near = [(1000 + n, n, "x", [0.001 * n, -0.0, 0.002]) for n in range(40)]
        rows = silent + near + [(5, 2, "x", [0.0, 0.0, 0.0])]
        df = spark.createDataFrame(rows, "id long, g long, k string, v array<double>")
        found = similarity.pairs(df, "id", "v", ["k"], 0.99, "g")
        want = sorted((min(a[0], b[0]), max(a[0], b[0])) for n, a in enumerate(rows) for b in rows[:n] if a[0] != b[0] and a[1] != b[1] and 1 / (1 + math.dist(a[3], b[3])) >= 0.99)
        got = found.withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r["left_id"], r["right_id"]) for r in got) == want
        assert max(Counter(r["task"] for r in got).values()) < 0.7 * len(got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeated_segments_count_once(spark, tmp_path):
    """Rows repeated whole are one row; rows of one id that differ are both met, as SQL has it."""
    def row(id, file_id, path="p"):
        return id, file_id, path, 0.5, 0.5, 0.2, 1.0, 0.1, 1000.0, 2000.0, 0.3, datetime.datetime(2020, 1, 1)

    schema = "id long, file_id long, path string, duration_s double, peak double, rms double, crest_factor double, zero_crossing_rate double, spectral_centroid double, spectral_rolloff double, spectral_flatness double, generated_at timestamp_ntz"
    spark.createDataFrame([row(1, 1), row(1, 1), row(2, 2), row(2, 2, "q"), row(3, 2)], schema).write.parquet(f"{tmp_path}/audio_segments.parquet")
    assert sorted(tuple(r) for r in QUERIES["similar_segments"](spark, str(tmp_path)).collect()) == [(1, 2, 1.0), (1, 2, 1.0), (1, 3, 1.0)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "AMB_RAIN_01.wav"), (2, "Rain on roof"), (3, "door"), (4, None)], "id long, t string")
    hit = lambda q: [r["id"] for r in docs.where(search.matches(F.col("t"), q)).orderBy("id").collect()]
    assert hit("rain") == [1, 2] and hit("rai*") == [1, 2] and hit('"rain on"') == [2] and hit("rain NOT roof") == [1] and hit("door OR roof") == [2, 3] and hit("") == []
    ranked = search.bm25(docs, search.postings(docs, "id", "t"), ["rain"]).collect()
    assert {r["id"] for r in ranked} == {1, 2}


def test_suggestions(spark):
    f = files(spark, [("/root/01_Weapons/SFX_GUNSHOT_PISTOL_01.wav", None), ("/root/x/Metal Hit 01.wav", None), ("/root/x/Metal Hit 02.wav", None)])
    catalog = spark.createDataFrame([("AMBRain", "AMB", "AMBIENCE", "RAIN", None, ["drizzle"]), ("METLHit", "METL", "METAL", "HIT", None, ["metal strike"])], "cat_id string, cat_short string, category string, subcategory string, explanations string, synonyms array<string>")
    kept = tags.fused(tags.suggest(f, tags.suggestors(catalog, "/root")))
    got = {(r["file_id"], r["field"]): (r["value"], round(r["confidence"], 2)) for r in kept.collect()}
    assert got[1, "ucs_category"] == ("SFX", 0.75) and got[1, "ucs_subcategory"] == ("GUNSHOT", 0.75) and got[1, "description"] == ("Gunshot Pistol", 0.75) and got[1, "take_number"] == ("01", 0.75)
    assert got[2, "description"] == ("Metal Hit", 0.85) and got[2, "take_number"] == ("01", 0.85) and got[2, "ucs_subcategory"] == ("HIT", 0.86)


def test_name_tokens(spark):
    tests = {"AMB_RAIN_01": ["AMB", "RAIN", "01"], "rec 2020-01-31 24bit 48khz door": ["rec", "door"], "MKH8040 sh2301": ["MKH8040", "sh", "2301"], "sTAKE=48 Bell": ["Bell"], "a-b": [], "Door 44.1kHz 24-bit 44k1": ["Door"],
        "March 3rd, 2019 Rain": ["Rain"], "3 Mar 2019 Rain": ["Rain"], "20190303 Rain 12:30:05": ["Rain"], "2019 13 45 Rain": ["2019", "13", "45", "Rain"], "May Day": ["May", "Day"], "": []}
    df = spark.createDataFrame([(k,) for k in tests], "t string")
    assert {r[0]: r[1] for r in df.select("t", tags.name_tokens(F.col("t"))).collect()} == tests


def test_tag_plan_and_apply(spark):
    held = spark.createDataFrame([(1, "title", "Old"), (1, "keyword", "rain")], "file_id long, field string, value string")
    entries = spark.createDataFrame([(1, 1, "title", "New"), (2, 1, "keywords", " RAIN "), (3, 1, "keyword", "wind"), (4, 1, "keyword", "Wind"), (5, 2, "title", "T"), (6, 2, "title", "U")], "entry_id long, file_id long, field string, value string")
    plan = tags.planned(entries, held)
    assert {r["entry_id"]: r["action"] for r in plan.collect()} == {1: "skip_existing", 2: "skip_existing", 3: "add", 4: "skip_existing", 5: "add", 6: "skip_existing"}
    once = tags.applied(held, plan, F.lit(None).cast("timestamp_ntz")) if "created_at" in held.columns else tags.applied(held.withColumns({"plan_entry_id": F.lit(None).cast("long"), "created_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")}), plan, F.lit(None).cast("timestamp_ntz"))
    assert once.count() == 4
    assert tags.applied(once, plan, F.lit(None).cast("timestamp_ntz")).count() == 4  # applying again changes nothing


def test_layout(spark):
    f = files(spark, [("/l/A:b.wav", None), ("/l/A_b.wav", None), ("/l/Gra\u0301vel & co.wav", None), ("/l/door.wav", None)])
    # a decomposed name is composed; a name that would become another file's is a conflict
    assert {r["id"]: r["status"] for r in layout.rename_plan(f, "safe").collect()} == {1: "conflict", 3: "planned"}
    assert {r["id"]: r["target"] for r in layout.rename_plan(f, "portable").collect()}[3] == "/l/Gravel and co.wav"
    assert {r["id"]: r["target"] for r in layout.rename_plan(f, "ucs").collect()}[4] == "/l/SFX_MISC_DOOR.wav"
    names_ = spark.createDataFrame([("01 - Doors",), ("[Rain]",), ("2020",), ("7 Metal",), ("Plain",), ("12 Monkeys",), ("[a](b)",), ("1234 - x",), (None,)], "n string")
    assert [r[0] for r in names_.select(layout.without_sort_number(F.col("n"))).collect()] == ["Doors", "Rain", None, "Metal", None, None, None, None, None]
    long = spark.createDataFrame([("/l/" + "é" * 200 + ".wav",), ("/l/" + "ガ" * 100 + ".wav",), ("/l/" + "a" * 300 + ".wav",), ("/l/x" + "😀" * 90 + ".wav",), ("/l/short.wav",)], "p string")
    cut = [r[0] for r in long.select(layout.shortened(F.col("p"), 60)).collect()]
    assert all(len(c.encode()) <= 60 and "\ufffd" not in c for c in cut) and cut[4] == "/l/short.wav" and min(len(c.encode()) for c in cut[:4]) > 55
    stats = layout.folder_stats(files(spark, [("/l/Rain/Rain/wav/1.wav", None), ("/l/GDC_1/a.wav", None), ("/l/GDC_2/a.wav", None), ("/l/GDC_3/a.wav", None)]))
    assert {(r["folder"], r["kind"]) for r in layout.nesting(stats).collect()} >= {("/l/Rain/Rain", "repeated_folder_name"), ("/l/Rain", "single_child_chain"), ("/l/Rain/Rain/wav", "low_value_wrapper")}
    assert {r["new_name"] for r in layout.common_prefix(stats).collect()} == {"1", "2", "3"}


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k long, v string, at int")
    new = spark.createDataFrame([(2, "B", 99), (3, "c", 30), (None, "N", 7)], "k long, v string, at int")
    got = {r["k"]: (r["v"], r["at"]) for r in snapshots.upsert(old, new, ["k"], ["at"]).collect()}
    assert got == {1: ("a", 10), 2: ("B", 20), 3: ("c", 30), None: ("N", 0)}
    again = snapshots.upsert(snapshots.upsert(old, new, ["k"], ["at"]), new, ["k"], ["at"])
    assert {r["k"]: (r["v"], r["at"]) for r in again.collect()} == got
    diff = {r["k"]: r["status"] for r in snapshots.difference(old.where("k > 0"), new.where("k > 0"), "k", ["v"]).collect()}
    assert diff == {1: "missing", 2: "updated", 3: "registered"}
    rows = spark.createDataFrame([(1, "p", None), (2, "r", None), (3, "s", "approved")], "entry_id long, field string, review_status string")
    seen = snapshots.reviewed(rows, F.col("entry_id") <= 2, F.col("entry_id") == 2)
    assert {r["entry_id"]: r["review_status"] for r in seen.collect()} == {1: "approved", 2: "rejected", 3: "approved"}


def test_scan_and_drift(spark):
    now = spark.createDataFrame([("/a", 1, 1.0), ("/b", 2, 1.0), ("/c", 1, 1.0), ("/d", 1, 1.0)], "path string, size_bytes long, mtime double")
    idx = spark.createDataFrame([("/a", 1, 1.0, 48000, "h", "2020-01-01"), ("/b", 1, 1.0, 48000, "h", "2020-01-01"), ("/c", 1, 1.0, None, "h", None)], "path string, size_bytes long, mtime double, sample_rate int, md5 string, metadata_scanned_at string")
    assert {r["path"]: r["reason"] for r in snapshots.to_scan(now, idx).collect()} == {"/b": "changed", "/c": "incomplete", "/d": "new"}
    assert {r["path"] for r in snapshots.to_scan(now, idx, "hash").collect()} == {"/b", "/d"}
    assert snapshots.to_scan(now, idx, force=True).count() == 4


def test_write_plan(spark):
    t = spark.createDataFrame([(1, "title", "A"), (1, "comment", "x"), (1, "comment", "y"), (2, "title", "B"), (3, "title", "C")], "file_id long, field string, value string")
    keys = spark.createDataFrame([("title", "riff_info", "inam"), ("comment", "riff_info", "icmt")], "field string, namespace string, key string")
    held = spark.createDataFrame([(2, "riff_info", "inam", "B"), (3, "riff_info", "inam", "Z")], "file_id long, namespace string, key string, value string")
    got = sorted((r["file_id"], r["key"], r["action"]) for r in snapshots.write_plan(t, held, keys).collect())
    assert got == [(1, "icmt", "conflict"), (1, "icmt", "conflict"), (1, "inam", "add"), (2, "inam", "skip_same"), (3, "inam", "replace")]


@pytest.mark.parametrize("query", ["dup_groups", "pack_overlaps", "similar_pairs", "tag_proposals"])
def test_no_cartesian_products(spark, sf, query):
    from echolot.queries.catalog import QUERIES

    plan = QUERIES[query](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_feedback_selection_staleness_retention(spark):
    schema = "backend string, scope string, left_file_id long, left_segment_index int, right_file_id long, right_segment_index int, state string, note string, created_at string, updated_at string"
    old = spark.createDataFrame([("b", "file", 1, None, 2, None, "similar", None, "t0", "t0")], schema)
    new = spark.createDataFrame([("b", "file", 2, None, 1, None, "rejected", None, "t1", "t1"), ("b", "file", 2, None, 1, -1, "similar", None, "t2", "t2"), ("b", "file", 3, 0, 1, 4, "similar", None, "t1", "t1")], schema)
    got = {(r["left_file_id"], r["right_file_id"]): (r["state"], r["created_at"]) for r in snapshots.merge_feedback(old, new).collect()}
    assert got == {(1, 2): ("similar", "t0"), (1, 3): ("similar", "t1")}
    plan = spark.createDataFrame([("Title", "a"), ("comment", "b")], "field string, source string")
    assert snapshots.selected(plan, field=["title "], source=[]).count() == 1
    arts = spark.createDataFrame([("a", "/r", 5), ("b", "/r", 1), ("c", "/x", 9), ("d", None, 9)], "path string, root string, created_at int")
    stale = {r["path"]: r["stale"] for r in snapshots.staleness(arts, "/r", spark.createDataFrame([(3,)], "last_scan int")).collect()}
    assert stale == {"a": None, "b": "older_than_scan", "c": "other_root", "d": "no_root"}
    old_ones = snapshots.expired(spark.createDataFrame([("x_20240101_000000.db",), ("x_20240301_000000.db",), ("x.db",)], "path string"), 30, "2024-03-10")
    assert [r["path"] for r in old_ones.collect()] == ["x_20240101_000000.db"]


def test_folder_categories_and_vendors(spark):
    f = files(spark, [(f"/l/1000/Gun Shot {i}.wav", None) for i in range(3)] + [("/l/2000/Door.wav", None)])
    assert [tuple(r) for r in layout.folder_categories(f).collect()] == [("/l/1000", "Weapons", 6)]
    stats = spark.createDataFrame([("/l/a", "Acme - Big Booms"), ("/l/b", "01_acme_Rain (HD)"), ("/l/c", "Acme"), ("/l/d", "Acmeville x")], "folder string, name string")
    got = {r["folder"]: r["product"] for r in layout.vendor_product(stats, spark.createDataFrame([("Acme",)], "vendor string")).collect()}
    assert got == {"/l/a": "Big Booms", "/l/b": "Rain (HD"}


def test_near_duplicate_groups_and_random_page(spark):
    found = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (4, 5, 1.0), (2, 9, 1.0)], "left_id long, right_id long, score double")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "x"), (5, "x"), (9, "b")], "id long, md5 string")
    got = [tuple(r) for r in similarity.near_duplicates(found, items, "id", "md5").collect()]
    assert got == [(1, 3, 2, 0.95, 1)]
    page = [r["id"] for r in similarity.random_page(spark.range(100), 5, 3, "id").collect()]
    assert page == [r["id"] for r in similarity.random_page(spark.range(100).repartition(7), 5, 3, "id").collect()] and page != sorted(page)
