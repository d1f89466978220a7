"""Readers and writers: folder listings, catalogs, tag lists, plans, reports, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths
from . import schemas


def listing(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """(path, filename, stem, extension, size_bytes, mtime[, content]) of all audio files below root, junk left out.

    The content column is read only if asked for.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    rows = raw.withColumn("path", path).where(names.is_audio(F.col("path")) & ~names.is_junk_file(F.col("path")) & ~names.in_junk_folder(F.col("path")))
    base = paths.basename("path")
    return rows.select(
        "path", base.alias("filename"), paths.stem(base).alias("stem"), F.lower(paths.suffix(base)).alias("extension"), F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") / F.lit(1e6)).alias("mtime"), *([F.col("content")] if with_content else []),
    )


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Category list with header (CatShort, Category, SubCategory, CatID, Explanations, Synonyms): incomplete rows dropped, codes in capitals."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = {"CatShort", "Category", "SubCategory", "CatID"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit("")
    rows = raw.select(
        text("CatID").alias("cat_id"), F.upper(text("CatShort")).alias("cat_short"), F.upper(text("Category")).alias("category"), F.upper(text("SubCategory")).alias("subcategory"),
        F.nullif(text("Explanations"), F.lit("")).alias("explanations"), F.filter(F.transform(F.split(text("Synonyms"), ","), lambda x: F.trim(x)), lambda x: x != "").alias("synonyms"),
    )
    return rows.where("cat_id <> '' AND cat_short <> '' AND category <> '' AND subcategory <> ''")


def catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a catalog document."""
    entry = schemas.schema("ucs_entries").simpleString()
    doc = spark.read.schema(f"entries array<{entry}>").option("multiLine", True).json(path)
    return doc.select(F.explode("entries").alias("e")).select("e.*")


def tag_csv(spark: SparkSession, path: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of a tag list (file_id or path or filename; field; value): each row finds its file by id, path or a unique name."""
    raw = spark.read.option("header", True).csv(path, schema="file_id long, path string, filename string, field string, value string")
    raw = raw.withColumn("row", F.monotonically_increasing_id())
    by_id = files.select(F.col("id").alias("_i1"), F.col("id").alias("file_id"))
    by_path = files.select(F.col("id").alias("_i2"), F.col("path"))
    by_name = files.groupBy("filename").agg(F.min("id").alias("_i3"), F.count("*").alias("_n"))
    rows = raw.join(by_id, "file_id", "left").join(by_path, "path", "left").join(by_name, "filename", "left")
    found = F.coalesce("_i1", "_i2", F.when(F.col("_n") == 1, F.col("_i3")))
    error = (
        F.when(F.trim(F.coalesce("field", F.lit(""))) == "", "no field").when(F.trim(F.coalesce("value", F.lit(""))) == "", "no value")
        .when(found.isNull() & (F.col("_n") > 1), "ambiguous file name").when(found.isNull(), "no such file")
    )
    rows = rows.select("row", found.alias("file_id"), "field", "value", error.alias("error"))
    return rows.where("error IS NULL").select(F.col("row").alias("entry_id"), "file_id", "field", "value"), rows.where("error IS NOT NULL")


def plan_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of plan documents, one row each, with the document they come from."""
    docs = spark.read.schema(f"schema_version int, kind string, entries array<{schemas.PLAN_ENTRY}>").option("multiLine", True).json(path)
    return docs.select(F.input_file_name().alias("document"), "kind", F.posexplode("entries").alias("row_index", "e")).select("document", "kind", "row_index", "e.*")


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime, kind) of the JSON documents of a folder, newest first; kind is read from the document's head."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(folder)
    head = F.substring(F.decode(F.substring("content", 1, 4096), "UTF-8"), 1, 4096)
    kind = F.nullif(F.regexp_extract(head, r'"(?:kind|command)"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), kind.alias("kind")).orderBy(F.desc("mtime"), "path")


def export_rows(files: DataFrame, tags: DataFrame) -> DataFrame:
    """files with their tags as one JSON text column, ready for write.csv(header=True)."""
    one = F.struct("field", "value", "source", "confidence")
    text = tags.groupBy(F.col("file_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("tags"))
    return files.join(text, "id", "left").withColumn("tags", F.coalesce("tags", F.lit("[]")))


def sidecars(files: DataFrame, tags: DataFrame) -> DataFrame:
    """One document per tagged file: path, size, time and its tags."""
    one = F.struct("field", "value", "source", "method", "confidence")
    per = tags.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("tags"))
    return files.join(per, "id").select("path", "size_bytes", "mtime", "tags")


def from_sidecars(docs: DataFrame, files: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags of sidecar documents that their (unchanged) file does not have: exact field and value."""
    f = files.select(F.col("id").alias("file_id"), "path", F.col("mtime").alias("_m"))
    rows = docs.join(f, "path").where(F.col("mtime").eqNullSafe(F.col("_m"))).select("file_id", F.explode("tags").alias("t")).select("file_id", "t.*")
    return rows.join(tags.select("file_id", "field", "value"), ["file_id", "field", "value"], "left_anti").dropDuplicates(["file_id", "field", "value"])


def write_report(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Rows as JSON lines through Spark's commit protocol: readers see all or nothing."""
    (df if partitions is None else df.coalesce(partitions)).write.mode("overwrite").json(path)


def document_rows(docs: DataFrame, id_col: str, lists: dict[str, Column]) -> DataFrame:
    """(artifact_id, row_type, row_index, body): the entries of several arrays of each document as rows."""
    out = None
    for kind, col in lists.items():
        part = docs.select(F.col(id_col).alias("artifact_id"), F.lit(kind).alias("row_type"), F.posexplode(col).alias("row_index", "e")).select("artifact_id", "row_type", "row_index", F.to_json("e").alias("body"))
        out = part if out is None else out.unionByName(part)
    return out
