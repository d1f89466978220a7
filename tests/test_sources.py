"""Readers, RIFF parsing, descriptors, streams."""

import io
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolot.plans import snapshots
from echolot.signal import descriptors, riff
from echolot.sources import readers, schemas
from echolot.streaming import streams


def wav(x: np.ndarray, rate: int = 44100, extra: bytes = b"") -> bytes:
    x = np.atleast_2d(x.T).T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    data = out.getvalue() + extra
    return data[:4] + struct.pack("<I", len(data) - 8) + data[8:]


def tone(freq: float, seconds: float, rate: int = 44100) -> np.ndarray:
    return 0.4 * np.sin(2 * np.pi * freq * np.arange(int(seconds * rate)) / rate)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


BEXT = chunk(b"bext", b"A description".ljust(256, b"\0") + b"Someone".ljust(32, b"\0") + b"Ref".ljust(32, b"\0") + b"\0" * 282)
INFO = chunk(b"LIST", b"INFO" + chunk(b"INAM", b"Title\0") + chunk(b"ICMT", b""))


def test_riff():
    data = wav(tone(440, 0.5), extra=BEXT + INFO)
    got = riff.info(data)
    assert (got["sample_rate"], got["bit_depth"], got["channels"], got["duration_s"], got["subtype"], got["has_bext"], got["has_riff_info"], got["error"]) == (44100, 16, 1, 0.5, "PCM_16", 1, 1, None)
    assert riff.fields(data) == [("bext", "description", "A description"), ("bext", "originator", "Someone"), ("bext", "originatorreference", "Ref"), ("riff_info", "inam", "Title")]
    assert riff.info(b"")["error"] and riff.info(b"RIFFxxxxWAVE")["error"] == "Malformed 'fmt ' chunk" and riff.info(wav(tone(1, 0.1))[:36])["error"] == "No 'data' chunk marker"
    x, rate = riff.samples(data)
    assert rate == 44100 and x.shape == (22050, 1) and abs(float(x.max()) - 0.4) < 1e-3


@pytest.mark.parametrize("bits", [8, 24, 32])
def test_sample_formats(bits):
    raw = {8: np.array([0, 128, 255], np.uint8).tobytes(), 24: b"\x00\x00\x80\x00\x00\x00\xff\xff\x7f", 32: np.array([-(2**31), 0, 2**31 - 1], "<i4").tobytes()}[bits]
    body = b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000 * bits // 8, bits // 8, bits)) + chunk(b"data", raw)
    x, _ = riff.samples(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert np.allclose(x[:, 0], [-1, 0, 1], atol=0.01)


def test_segments_and_descriptors(spark):
    quiet = lambda s: np.zeros(int(s * 44100))
    pulses = np.concatenate([quiet(0.2), tone(440, 0.2), quiet(0.35), tone(660, 0.25), quiet(0.2)])
    found = descriptors.segments(pulses.astype(np.float32), 44100)
    assert len(found) == 2 and abs(found[0]["start_s"] - 0.2) < 0.06 and found[1]["spectral_centroid"] > found[0]["spectral_centroid"]
    low, high = (descriptors.describe(tone(f, 0.5)[:, None].astype(np.float32), 44100) for f in (300, 3000))
    assert low["spectral_centroid"] < high["spectral_centroid"] and low["zero_crossing_rate"] < high["zero_crossing_rate"] and low["silence_ratio"] < 0.01
    stereo = np.stack([tone(440, 0.2)] * 2, axis=1)
    rows = [(1, wav(pulses)), (2, wav(stereo)), (3, b"junk"), (4, wav(np.stack([tone(440, 0.2), tone(500, 0.2)], axis=1))), (5, None)]
    df = spark.createDataFrame(rows, "file_id long, content binary")
    got = {r["file_id"]: r for r in descriptors.file_descriptors(df).collect()}
    assert got[1]["segment_count"] == 2 and got[3]["error"] and got[5]["error"] and got[2]["error"] is None
    assert descriptors.segment_descriptors(df).where("file_id = 1").count() == 2
    assert [(r["file_id"], r["confidence"]) for r in descriptors.dual_mono(df).collect()] == [(2, "exact")]


def test_empty_signal():
    got = descriptors.describe(np.zeros((0, 1), np.float32), 44100)
    assert got["rms"] == 0 and got["silence_ratio"] == 1 and got["segment_count"] == 0


def test_listing_and_enrichment(spark, tmp_path):
    (tmp_path / "lib" / "_wfCache").mkdir(parents=True)
    for name in ("AMB_RAIN_01.wav", "._AMB_RAIN_01.wav", "_wfCache/x.wav", "notes.txt", "bad!.wav"):
        (tmp_path / "lib" / name).write_bytes(wav(tone(440, 0.1), extra=INFO) if name == "AMB_RAIN_01.wav" else b"junk")
    rows = readers.listing(spark, str(tmp_path / "lib"), with_content=True)
    got = {r["filename"]: r for r in rows.select("*", riff.audio_info("content").alias("i"), F.md5("content").alias("h"), riff.embedded_fields("content").alias("f")).collect()}
    assert set(got) == {"AMB_RAIN_01.wav", "bad!.wav"}
    assert got["AMB_RAIN_01.wav"]["i"]["sample_rate"] == 44100 and got["AMB_RAIN_01.wav"]["f"][0]["value"] == "Title" and got["bad!.wav"]["i"]["error"] == "Format not recognised"


def test_catalog_and_tags(spark, tmp_path):
    (tmp_path / "c.csv").write_text('\ufeffCatShort,Category,SubCategory,CatID,Explanations,Synonyms\namb,Ambience,rain,AMBRain,,"drizzle, , shower"\nx,,y,z,,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.catalog_csv(spark, str(tmp_path / "c.csv")).collect()] == [("AMBRain", "AMB", "AMBIENCE", "RAIN", None, ["drizzle", "shower"])]
    (tmp_path / "c.json").write_text(json.dumps({"entries": [{"cat_id": "A", "synonyms": []}]}))
    assert readers.catalog_json(spark, str(tmp_path / "c.json")).first()["cat_id"] == "A"
    (tmp_path / "t.csv").write_text("file_id,path,filename,field,value\n1,,,title,A\n,/p/2,,title,B\n,,dup.wav,title,C\n,,only.wav,title,D\n9,,,title,E\n1,,,,F\n")
    files = spark.createDataFrame([(1, "/p/1", "dup.wav"), (2, "/p/2", "dup.wav"), (3, "/p/3", "only.wav")], "id long, path string, filename string")
    entries, errors = readers.tag_csv(spark, str(tmp_path / "t.csv"), files)
    assert {(r["file_id"], r["value"]) for r in entries.collect()} == {(1, "A"), (2, "B"), (3, "D")}
    assert {(r["value"], r["error"]) for r in errors.collect()} == {("C", "ambiguous file name"), ("E", "no such file"), ("F", "no field")}


def test_plans_exports_sidecars(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps({"kind": "tag_plan", "entries": [{"entry_id": 1, "path": "/a", "field": "title"}, {"entry_id": 2}]}))
    assert [(r["row_index"], r["entry_id"]) for r in readers.plan_json(spark, str(tmp_path / "plan.json")).collect()] == [(0, 1), (1, 2)]
    assert readers.artifacts(spark, str(tmp_path)).first()["kind"] == "tag_plan"
    files = spark.createDataFrame([(1, "/a", 5, 1.0), (2, "/b", 5, 2.0)], "id long, path string, size_bytes long, mtime double")
    tags = spark.createDataFrame([(1, "title", "T", "manual", "m", 0.5)], "file_id long, field string, value string, source string, method string, confidence double")
    assert {r["id"]: r["tags"] for r in readers.export_rows(files, tags).collect()}[2] == "[]"
    docs = readers.sidecars(files, tags)
    assert readers.from_sidecars(docs, files, tags).count() == 0
    assert readers.from_sidecars(docs, files, tags.limit(0)).count() == 1
    assert readers.from_sidecars(docs, files.withColumn("mtime", F.col("mtime") + 1), tags.limit(0)).count() == 0
    assert schemas.conformed(files, "files").columns[:3] == ["id", "path", "filename"]
    readers.write_report(files, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_stream_into_snapshots(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "k long, v string, at int"
    sink = streams.SnapshotSink(spark, str(out), ["k"], ["at"])
    for n, rows in enumerate([[(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(1, "d", 3), (3, "e", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        sink.writer(streams.events(spark, str(src), schema), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        got = {r["k"]: r["v"] for r in sink.read(n).collect()}
    assert got == {1: "d", 2: "c", 3: "e"}
    sink(spark.createDataFrame([(1, "d", 3), (3, "e", 1)], schema), 1)  # the batch again: the same version
    assert {r["k"]: r["v"] for r in sink.read(1).collect()} == got


def test_stream_windows_and_deduplication(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    live = streams.events(spark, str(tmp_path / "e"), schema, 1)
    once = streams.deduplicated(live, "ts", "40 days", ["user_id", "event_type"])
    once.writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("dedup").count() == events.select("user_id", "event_type").distinct().count()
    agg = streams.windowed(live, "ts", "6 hours", None, "60 days", "event_type", value="value")
    agg.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == events.count()


def test_latest_is_an_aggregation(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k long, v string, at int")
    got = snapshots.latest(rows, ["k"], [F.col("at")])
    assert got.first()["v"] == "b" and "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_scan_builds_and_updates_the_index(spark, tmp_path):
    from echolot.sources import scan

    lib = tmp_path / "lib"
    (lib / "__MACOSX").mkdir(parents=True)
    (lib / "AMB_RAIN_01.wav").write_bytes(wav(tone(440, 0.1), extra=INFO + BEXT))
    (lib / "bad!name.wav").write_bytes(b"junk")
    (lib / "__MACOSX" / "x.wav").write_bytes(b"junk")
    empty = {n: spark.createDataFrame([], schemas.schema(n)) for n in ("files", "fn_issues", "metadata_fields")}
    one = scan.scan(spark, str(lib), empty["files"], empty["fn_issues"], empty["metadata_fields"], "full", "2024-01-01 00:00:00")
    rows = {r["filename"]: r for r in one["files"].collect()}
    assert rows["AMB_RAIN_01.wav"]["id"] == 1 and rows["AMB_RAIN_01.wav"]["is_ucs"] == 1 and rows["AMB_RAIN_01.wav"]["md5"] and rows["AMB_RAIN_01.wav"]["has_bext"] == 1
    assert rows["bad!name.wav"]["scan_error"] and {(r["file_id"], r["issue"]) for r in one["fn_issues"].collect()} == {(2, "risky_chars")}
    assert one["metadata_fields"].where("file_id = 1").count() == 4
    held = {n: spark.createDataFrame(one[n].collect(), schemas.schema(n)) for n in empty}
    again = scan.scan(spark, str(lib), held["files"], held["fn_issues"], held["metadata_fields"], "index", "2024-01-02 00:00:00")
    assert again["changed"].count() == 0 and again["files"].count() == 2
    (lib / "new.wav").write_bytes(wav(tone(500, 0.1)))
    more = scan.scan(spark, str(lib), held["files"], held["fn_issues"], held["metadata_fields"], "hash", "2024-01-03 00:00:00")
    assert {r["filename"]: r["id"] for r in more["changed"].collect()} == {"new.wav": 3} and more["files"].count() == 3 and more["fn_issues"].count() == 1
    content = readers.listing(spark, str(lib), True).select("path", "content")
    full = scan.backfill(more["files"], content, "audio", "2024-01-04 00:00:00")
    assert {r["filename"]: r["sample_rate"] for r in full.where("scan_error IS NULL").collect()} == {"AMB_RAIN_01.wav": 44100, "new.wav": 44100}
    assert "| 1 |" in scan.markdown("Audit", full.select("id").orderBy("id"))
