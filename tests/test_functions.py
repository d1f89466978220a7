"""Path, name and value expressions on literals."""

import pytest
from pyspark.sql import functions as F

from echolot.functions import names, paths, values


def evaluate(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


@pytest.mark.parametrize("path,key", [
    ("C:\\Lib\\A\\one.wav", "c:/lib/a/one.wav"), ("c:/lib//A/", "c:/lib/a"), ("\\\\Host\\Share\\x", "//host/share/x"), ("/Srv//a/", "/Srv/a"), ("/", "/"), ("", ""), (None, None), ("C:\\", "c:"),
])
def test_path_key(spark, path, key):
    assert evaluate(spark, paths.path_key, path) == [key]


def test_scope_excludes_sibling_prefixes(spark):
    got = evaluate(spark, lambda p: paths.in_scope(p, F.lit("c:/lib")), "C:\\Lib\\A\\one.wav", "C:\\Lib2\\C\\one.wav", "C:\\LIB", None)
    assert got == [True, False, True, None]
    assert evaluate(spark, lambda p: paths.relative(p, F.lit("/srv/a")), "/srv/a/B/c.wav", "/srv/ab/c.wav", "/srv/a") == ["B/c.wav", None, ""]


def test_parts(spark):
    assert evaluate(spark, paths.basename, "/a/b.c", "a\\b", "x") == ["b.c", "b", "x"]
    assert evaluate(spark, paths.parent, "/a/b.c", "a\\b", "x") == ["/a", "a", None]
    assert evaluate(spark, paths.suffix, "a.b.WAV", ".hidden", "none", "a.") == [".WAV", "", "", ""]
    assert evaluate(spark, paths.stem, "/x/a.b.WAV", ".hidden") == ["a.b", ".hidden"]
    assert evaluate(spark, paths.ancestors, "/a/b/c.wav", "D:\\X\\y.wav", "z.wav") == [["/a", "/a/b"], ["d:", "d:/x"], []]


def test_windows_rules(spark):
    assert evaluate(spark, paths.reserved_name, "con.txt", "COM1", "console", "nul. ", "") == ["CON", "COM1", None, "NUL", None]
    assert evaluate(spark, paths.path_collision_key, "/A/B. /c.WAV ", "/a/b/C.wav") == ["/a/b/c.wav", "/a/b/c.wav"]
    assert evaluate(spark, paths.trimmed_by_windows, "a.", "a ", "a") == [True, True, False]


@pytest.mark.parametrize("stem,want", [
    ("Metal Hit 01", ("metal hit", "01", "numbered_sequence")), ("Rain_L", ("rain", "L", "channel_set")), ("rain - Right", ("rain", "RIGHT", "channel_set")), ("Door take 3", ("door", "3", "numbered_sequence")),
    ("Boom_take07", ("boom", "07", "numbered_sequence")), ("ab 01", None), ("a_L", None), ("Door", None), (None, None),
])
def test_related(spark, stem, want):
    assert evaluate(spark, names.related, stem) == [want]


def test_ucs(spark):
    got = evaluate(spark, names.ucs_parts, "SFX_GUNSHOT_PISTOL_01", "amb_rain", "AMB_RAIN", None)
    assert [tuple(g) for g in got] == [(True, "SFX", "GUNSHOT", "PISTOL_01"), (False, None, None, None), (True, "AMB", "RAIN", None), (False, None, None, None)]


def test_health(spark):
    got = evaluate(spark, lambda c: names.health_issues(c, names.composed(c)), "cafe\u0301", "bad!name", "a:b", "CON.wav", " x", "x.", ".dot", "é" * 200, "fine")
    assert got[0] == ["unicode_normalization", "non_ascii"] and got[1] == ["risky_chars"] and got[2] == ["illegal_chars"] and got[3] == ["windows_reserved_name"]
    assert got[4] == ["leading_trailing_space"] and got[5] == ["trailing_dot_or_space"] and got[6] == ["dot_prefix"] and got[7] == ["name_too_long", "non_ascii"] and got[8] == []


def test_junk(spark):
    tests = ["/a/._x.wav", "/a/.DS_Store", "/a/x.reapeaks", "/a/x.wav", "/a/desktop.ini", "/a/x.txt"]
    assert evaluate(spark, names.is_junk_file, *tests) == [True, True, True, False, True, False]
    assert evaluate(spark, names.in_junk_folder, "/a/_wfCache/x", "/a/x") == [True, False]


def test_processed(spark):
    assert evaluate(spark, names.processed_words, "Door_Slam_EQ_wet 2", "Door") == [["eq", "wet"], []]
    assert evaluate(spark, names.unprocessed_key, "Door_Slam_EQ 2") == ["door slam"]


def test_scan_errors(spark):
    df = spark.createDataFrame([(b"\x00\x05\x16\x07abc", "x"), (b"\0\0\0\0", "x"), (b"RIFF", "No 'data' chunk marker"), (b"RIFF", "other"), (b"junk", "Format not recognised"), (b"", "odd")], "b binary, m string")
    got = [r[0] for r in df.select(names.scan_error_class(F.col("b"), F.col("m"))).collect()]
    assert got == ["appledouble", "all_zero", "riff_missing_data", "riff_unrecognized", "unknown_data", "unknown"]


def test_values(spark):
    assert evaluate(spark, values.text_list, '["a", "b"]', '"a"', "a", '["a', "", None, "null", "[]") == [["a", "b"], ["a"], ["a"], ['["a'], [], [], [], []]
    assert evaluate(spark, values.canonical_field, " Keywords", "IGNR", "Other", None) == ["keyword", "category", "other", None]
    assert evaluate(spark, values.value_key, " A  b\u00a0C ") == ["a b c"]
