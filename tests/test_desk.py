"""Review desk, containers, search fallbacks, sinks, numbering."""

import struct

import pytest
from pyspark.sql import functions as F

from echolot.operators import audits, duplicates, layout, search, similarity, workbench
from echolot.signal import containers, riff
from echolot.sources import scan
from echolot.streaming import streams


def test_junk_folders_sum_what_lies_below(spark):
    rows = [(1, "/l/__MACOSX/a.wav", 5), (2, "/l/__MACOSX/_wfCache/b.wav", 7), (3, "/l/x/_wfCache/c.wav", None), (4, "/l/x/d.wav", 9)]
    df = spark.createDataFrame(rows, "id long, path string, size_bytes long")
    assert {tuple(r) for r in audits.junk_folders(df).collect()} == {("/l/__MACOSX", 2, 12), ("/l/x/_wfCache", 1, 0)}
    assert audits.junk_folders(df.limit(0)).count() == 0


@pytest.mark.parametrize("literals", [200, 0])
@pytest.mark.parametrize("both_ways", [False, True])
def test_protection_by_literals_and_by_ancestors(spark, literals, both_ways, monkeypatch):
    monkeypatch.setattr(duplicates, "MAX_LITERAL_RULES", literals)
    f = spark.createDataFrame([(1, "/a/b/c.wav"), (2, "/a/bc/d.wav"), (3, "C:\\Lib\\x.wav"), (4, "/a"), (5, None), (6, "/a/b")], "id long, path string")
    rules = spark.createDataFrame([(2, "/a/b"), (1, "c:/lib"), (3, "/a/b/c.wav"), (4, None)], "rule_order int, folder string")
    got = {r["id"]: r["protected_by"] for r in duplicates.protected(f, rules, both_ways=both_ways).collect()}
    assert got == {1: "/a/b", 2: None, 3: "c:/lib", 4: "/a/b" if both_ways else None, 5: None, 6: "/a/b"}


def test_search_without_accents_and_broken_queries(spark):
    df = spark.createDataFrame([(1, "Café door"), (2, 'say "door'), (3, "slam"), (4, None), (5, "door slam cafe")], "id long, t string")
    index = search.postings(df, "id", "t")
    ids = lambda q, i=None: {r["id"] for r in search.find(df, "id", q, "t", index=i).collect()}
    for i in (None, index):
        assert ids("cafe", i) == {1, 5} and ids("CAFÉ door", i) == {1, 5} and ids('"door slam"', i) == {5} and ids("caf* NOT slam", i) == {1} and ids("slam OR café", i) == {1, 3, 5}
        assert ids('"door', i) == {2} and ids("door AND", i) == set() and ids("", i) == set()


def test_values_cleaned_by_field(spark):
    cases = {("keyword", "Heavy, RAIN 02 x"): "heavy rain", ("ucs_category", "wthr-rain!"): "WTHR RAIN", ("take_number", " 01  a "): "01 a", ("title", "big DOOR-slam 7"): "Big Door Slam", ("title", "12 3"): None, ("title", None): None, (None, "some thing"): "Some Thing"}
    df = spark.createDataFrame([k for k in cases], "f string, v string")
    assert {(r[0], r[1]): r[2] for r in df.select("f", "v", workbench.clean_value(F.col("f"), F.col("v"))).collect()} == cases


def test_jobs_settings_feedback_and_logs(spark):
    events = spark.createDataFrame([(1, 1, "a", "running"), (2, 1, "b", "finished"), (3, 2, "a", "running")], "event_id long, job_id long, at string, status string")
    assert [tuple(r)[::2] for r in workbench.interrupted(events, F.lit("z")).select("job_id", "at", "status").collect()] == [(2, "interrupted")]
    started = workbench.job_events(spark.range(2), "scan", F.col("id"), F.lit("now"), "running")
    assert {(r["job_id"], r["status"], r["error"]) for r in started.collect()} == {(0, "running", None), (1, "running", None)}
    kv = workbench.settings_upsert(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string"))
    assert {tuple(r) for r in kv.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    feedback = spark.createDataFrame([(1, 2, "confirmed"), (3, 4, "rejected"), (5, 99, "confirmed")], "left_file_id long, right_file_id long, state string")
    files = spark.createDataFrame([(i, f"/{i}") for i in range(1, 6)], "id long, path string")
    assert {(r["left_path"], r["right_path"]) for r in similarity.feedback_list(feedback, files, ("confirmed",)).collect()} == {("/1", "/2")}
    assert similarity.cleared(feedback, spark.createDataFrame([(2, 1)], "left_file_id long, right_file_id long")).count() == 2
    log = spark.createDataFrame([(1, "apply"), (2, "skip"), (3, "size_changed")], "entry_id long, outcome string")
    assert tuple(workbench.outcome_counts(log).first()) == (1, 1, 1) and workbench.log_rows(log, "p", "t", F.lit("now")).columns == ["plan", "tool", "applied_at", "entry_id", "outcome"]
    assert {r["backend"] for r in workbench.backends(spark).collect()} == {"spectral", "embedding"}


def test_descriptors_that_can_be_used_again(spark):
    files = spark.createDataFrame([(1, "/a", 10, 1.0, "m", None), (2, "/b", 20, 2.0, None, None), (3, "/c", 30, 3.0, "x", "bad")], "id long, path string, size_bytes long, mtime double, md5 string, scan_error string")
    same = (1, "v1", similarity.parameters_hash({"b": 2, "a": 1}), "rms", 30.0, 10, 1.0, "m", 1.0, 1.0, 1.0, 1.0, None)
    stored = spark.createDataFrame([same, (2, *same[1:5], 20, 2.5, None, 1.0, 1.0, 1.0, 1.0, None)], "file_id long, backend_version string, parameters_hash string, segment_method string, max_duration_s double, size_bytes long, mtime double, md5 string, spectral_centroid double, spectral_bandwidth double, spectral_rolloff double, spectral_flatness double, error string")
    current = similarity.descriptor_is_current("v1", similarity.parameters_hash({"a": 1, "b": 2}), "rms", 30.0)
    assert [r["id"] for r in similarity.to_describe(files, stored, current).collect()] == [2]
    assert [r["id"] for r in similarity.to_describe(files, stored, similarity.descriptor_is_current("v2", "", "rms", 30.0), max_files=1).collect()] == [1]
    assert similarity.to_describe(files, stored, current, force=True).count() == 2
    done = spark.createDataFrame([(2, None)], "file_id long, error string")
    assert tuple(similarity.crawl_counts(files, similarity.to_describe(files, stored, current), done).first()) == (2, 1, 1, 0)


def test_components_that_do_not_come_to_an_end(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "left_id long, right_id long")
    with pytest.raises(RuntimeError):
        similarity.components(chain, max_rounds=1)


def test_numbers_by_ranges(spark):
    df = spark.createDataFrame([(f"p{i:03}",) for i in range(57, -1, -1)], "path string").repartition(5)
    assert {r["path"]: r["n"] for r in scan.numbered(df, "path", "n").collect()} == {f"p{i:03}": i + 1 for i in range(58)}
    assert scan.numbered(df.limit(0), "path", "n").count() == 0


def test_sink_goes_on_from_the_newest_complete_version(spark, tmp_path):
    sink = streams.SnapshotSink(spark, str(tmp_path / "s"), ["k"], ["at"])
    row = lambda k, at: spark.createDataFrame([(k, at)], "k long, at long")
    sink(row(1, 1), 0)
    sink(row(2, 2), 3)  # versions 1 and 2 are missing
    assert {r["k"] for r in sink.read(3).collect()} == {1, 2} and sink.newest() == 3
    sink(row(2, 2), 3)  # again
    assert sink.read(3).count() == 2


def test_renames_and_nesting_from_the_deepest(spark):
    plan = spark.createDataFrame([(1, "/a/b", "/a/B", "planned"), (2, "/a/b/c/d", "/x", "planned"), (3, "/q", "/q", "conflict")], "id long, source string, target string, status string")
    assert [r["id"] for r in layout.rename_order(plan).collect()] == [2, 1]


def aiff_bytes(rate: int = 44100, frames: int = 22050) -> bytes:
    exponent = rate.bit_length() - 1
    ten = struct.pack(">HQ", 16383 + exponent, rate << (63 - exponent))
    body = b"AIFF" + b"COMM" + struct.pack(">I", 18) + struct.pack(">hIh", 2, frames, 24) + ten
    return b"FORM" + struct.pack(">I", len(body)) + body


def vorbis_comments(*pairs: str) -> bytes:
    out = struct.pack("<I", 3) + b"lib" + struct.pack("<I", len(pairs))
    return out + b"".join(struct.pack("<I", len(p.encode())) + p.encode() for p in pairs)


def flac_bytes() -> bytes:
    info = b"\x10\x00" * 2 + b"\0" * 6 + ((48000 << 44) | (1 << 41) | (15 << 36) | 96000).to_bytes(8, "big") + b"\0" * 16
    notes = vorbis_comments("TITLE=Réin", "no mark", "genre= ")
    return b"fLaC" + struct.pack(">I", len(info)) + info + struct.pack(">I", 1 << 31 | 4 << 24 | len(notes)) + notes


def ogg_bytes() -> bytes:
    ident = b"\x01vorbis" + struct.pack("<IBI", 0, 1, 22050) + b"\0" * 12
    page = lambda position, body: b"OggS\0\0" + struct.pack("<q", position) + b"\0" * 13 + body
    return page(0, ident) + page(0, b"\x03vorbis" + vorbis_comments("artist=Someone")) + page(44100, b"")


def id3_bytes() -> bytes:
    frame = lambda name, body: name + struct.pack(">I", len(body)) + b"\0\0" + body
    frames = frame(b"TIT2", b"\x01" + "Tür".encode("utf-16")) + frame(b"COMM", b"\x00eng\x00a note") + frame(b"XXXX", b"?")
    return b"ID3\x03\0\0" + bytes([0, 0, len(frames) >> 7, len(frames) & 0x7F]) + frames


def test_containers():
    assert containers.info(aiff_bytes()) == {"sample_rate": 44100, "bit_depth": 24, "channels": 2, "duration_s": 0.5, "subtype": "PCM_24"}
    assert containers.info(flac_bytes()) == {"sample_rate": 48000, "bit_depth": 16, "channels": 2, "duration_s": 2.0, "subtype": "PCM_16"}
    assert containers.fields(flac_bytes()) == [("vorbis", "title", "Réin")]
    assert containers.info(ogg_bytes()) == {"sample_rate": 22050, "bit_depth": None, "channels": 1, "duration_s": 2.0, "subtype": "VORBIS"} and containers.fields(ogg_bytes()) == [("vorbis", "artist", "Someone")]
    mp3 = id3_bytes() + bytes([0xFF, 0xFB, 0x90, 0xC0]) + b"\0" * 15_996
    assert containers.info(mp3) == {"sample_rate": 44100, "bit_depth": None, "channels": 1, "duration_s": 1.0, "subtype": "MPEG_LAYER_III"}
    assert containers.fields(mp3) == [("id3", "title", "Tür"), ("id3", "comment", "a note")]
    for whole in (aiff_bytes(), flac_bytes(), ogg_bytes(), mp3[:60]):
        for n in range(0, len(whole), 3):  # cut-off bytes never fail
            containers.info(whole[:n]), containers.fields(whole[:n]), riff.info(whole[:n])
    assert riff.info(aiff_bytes())["channels"] == 2 and riff.info(b"junk")["error"]
