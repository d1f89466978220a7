import pytest

from echolot import dsl

SCHEMA = "id long, path string, filename string, stem string, extension string, size_bytes long, sample_rate int, bit_depth int, channels int, duration_s double, md5 string, has_bext int, has_ixml int, has_riff_info int, has_adm int, has_cue_markers int, has_sampler int, is_ucs int, scan_error string"
ROWS = [
    (1, "/a/Rain.wav", "Rain.wav", "Rain", ".wav", 100, 48000, 24, 2, 1.0, "x", 1, 0, 0, 0, 0, 0, 0, None),
    (2, "/a/door.mp3", "door.mp3", "door", ".mp3", 50, 44100, 16, 1, 5.0, None, None, None, None, 0, 0, 0, 1, None),
    (3, "/b/50%_x", "50%_x", "50%_x", None, 70, None, None, None, None, None, 0, 1, 1, 0, 0, 0, 0, None),
    (4, "/b/bad.wav", "bad.wav", "bad", ".wav", 70, 48000, 24, 2, 1.0, None, 1, 0, 0, 0, 0, 0, 0, "broken"),
]


@pytest.mark.parametrize("query,ids", [
    ("", [1, 2, 3]), ("ext:wav", [1]), ("ext:.WAV", [1]), ("ext:wav,mp3", [1, 2]), ("-ext:mp3", [1]), ("rate:>=48000", [1]), ("size:50..70", [2, 3]), ("depth:16,24", [1, 2]), ("has:bext", [1]),
    ("missing:bext", [2, 3]), ("-missing:bext", [1]), ("rain", [1]), ("-rain", []), ('"50%_x"', [3]), ("a ext:mp3", [2]), ("is_ucs:1", [2]), ("duration:<2", [1]), ("_x", [1, 3][1:]),
])
def test_queries(spark, query, ids):
    files = spark.createDataFrame(ROWS, SCHEMA)
    assert [r["id"] for r in dsl.listing(files, query, "id").collect()] == ids


@pytest.mark.parametrize("query", ["foo:1", 'a "b', "size:abc", "ext:>3", "name:1..2", "has:nothing", "depth:,", "rate:1.2.3"])
def test_errors(query):
    with pytest.raises(dsl.QueryError):
        dsl.parse(query)


def test_sort_and_limit(spark):
    files = spark.createDataFrame(ROWS, SCHEMA)
    assert [r["id"] for r in dsl.listing(files, "", "-size", 2).collect()] == [1, 3]
    assert dsl.listing(files, "", "rate", 0).count() == 3
    with pytest.raises(dsl.QueryError):
        dsl.listing(files, "", "stem")


def test_filter_reaches_the_scan(spark, sf):
    plan = dsl.listing(spark.read.parquet(f"{sf}/files.parquet"), "rate:>=48000")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(sample_rate,48000)" in plan and "metadata_sources" not in plan.split("ReadSchema")[1]
