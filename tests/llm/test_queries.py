"""The problems' queries on the smallest test data: stated columns, and whole results against brute force where it is cheap."""

import itertools
import os

import pyarrow.parquet as pq
import pytest

from echolot.llm.queries import QUERIES
from echolot.llm.textform import consistent

COLUMNS = {
    "p1_found": ["md5", "field_name", "file_id"], "p2_found": ["id_a", "id_b"], "p3_found": ["taken_from", "term", "mark"], "p4_found": ["tag_id", "cat_id"], "p5_found": ["id_a", "id_b"],
    "p6_found": ["first_id", "copy_id"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(rows)) == len(rows)


def test_lookalikes_of_real_paths(spark, sf):
    t = pq.read_table(os.path.join(sf, "files.parquet"), columns=["id", "path"]).to_pylist()
    want = {tuple(sorted((a["id"], b["id"]))) for a, b in itertools.combinations([r | {"f": consistent(r["path"])} for r in t], 2) if a["f"] == b["f"] and a["path"] != b["path"]}
    assert {tuple(r) for r in QUERIES["p2_found"](spark, sf).collect()} == want


@pytest.mark.parametrize("name,table,columns", [
    ("p1_found", "files", {"id", "path", "size_bytes", "mtime", "md5", "metadata_sources", "scanned_at"}), ("p2_found", "files", {"id", "path"}), ("p6_found", "accepted_tags", {"id", "file_id", "field", "value"}),
])
def test_scans_read_only_what_is_needed(spark, sf, name, table, columns):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else schemas are cut off in the plan's text
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if f"{table}.parquet" in line and "ReadSchema" in line]
    assert scans
    for line in scans:
        read = {f.split(":")[0] for f in line.split("ReadSchema: struct<")[1].split(">")[0].split(",")}
        assert read <= columns
    assert "CartesianProduct" not in plan


def test_survivors_need_no_window(spark, sf):
    plan = QUERIES["p1_found"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_tags_are_read_and_shuffled_once(spark, sf):
    df = QUERIES["p6_found"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Scan parquet") == 1
