"""Duplicates hidden by formatting differences (problem 6).

Canonical text, hashed to 128 bits and aggregated with map-side combining.  A second,
independent hash tells different texts under one 128-bit hash apart.  Collision checks:
a third signature of the text must be one for each group, and where the collapsed
records come out, the texts themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textform import consistent_col

#: Between these marks the parts of a list value stand.
LIST_MARKS = r"[,;|/、，；]"


def plain_text(col: Column | str) -> Column:
    """Consistent form, case folded, without blanks and punctuation.

    A point between two digits belongs to the number and stays.  NULL stays NULL.
    """
    form = consistent_col(col, "fold")
    return F.regexp_replace(form, r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{M}\p{N}.]", "")


def plain_list(col: Column | str) -> Column:
    """Like plain_text for a list value: its parts in canonical form, sorted, repeated and empty parts as they come.

    Blank parts are dropped; equal parts are kept as often as they stand.
    """
    col = F.col(col) if isinstance(col, str) else col
    form = F.split(consistent_col(col, "fold"), LIST_MARKS)
    parts = F.transform(form, lambda x: F.regexp_replace(x, r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{M}\p{N}.]", ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), ",")


def _hashed(rows: DataFrame, keys: list[str], id_col: str, kept: list[str]) -> DataFrame:
    """Rows with copy_id, the canonical text t, its hashes h and h2 and its signature; kept columns under names of their own."""
    # known never to be NULL, so that no filter is put below one use of the shuffle only
    text = F.coalesce(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}), F.lit(""))
    base = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("copy_id"), text.alias("t"), *[F.col(c).alias(f"_k_{c}") for c in kept])
    signature = F.shiftleft(F.crc32("t"), 31).bitwiseXOR(F.hash("t").cast("long"))
    return base.withColumns({"h": F.coalesce(F.unhex(F.md5("t")), F.lit(b"")), "h2": F.xxhash64("t"), "sign": signature})


def _unless(clash: Column, value: str, of: DataFrame) -> Column:
    """value; the query fails and says so instead of counting different texts as one."""
    return F.when(clash, F.raise_error(F.lit("two texts under one hash")).cast(of.schema[value].dataType)).otherwise(F.col(value))


def collapsed(rows: DataFrame, keys: list[str], id_col: str, kept: list[str] | None = None) -> DataFrame:
    """(first_id, copies, n_rows, kept...): each set of rows that agree in all key columns, collapsed into its first row, with its number of copies.

    first_id is the smallest id, copies the number of distinct ids, n_rows that of rows;
    kept columns are those of the row first_id (of rows stored twice with different content
    the least).  NULL keys agree with NULL and differ from ''; rows with NULL id take no
    part.  The least and the greatest text of each set are compared: should two texts ever
    agree in all hashes, the query fails.
    """
    kept = kept or []
    hashed = _hashed(rows, keys, id_col, kept)
    first = F.min(F.struct("copy_id", *[f"_k_{c}" for c in kept])).alias("first")
    # distinct ids first (rows stored twice), combined map-side, then the groups
    ids = hashed.groupBy("h", "h2", "copy_id").agg(F.count("*").alias("stored"), F.min("t").alias("lo"), F.max("t").alias("hi"), first)
    groups = ids.groupBy("h", "h2").agg(F.min("copy_id").alias("first_id"), F.count("*").alias("copies"), F.sum("stored").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"))
    return groups.select(_unless(F.col("lo") != F.col("hi"), "first_id", groups).alias("first_id"), "copies", "n_rows", *[F.col(f"first._k_{c}").alias(c) for c in kept])


def copies(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(first_id, copy_id): each further distinct id of a set of rows that say the same.

    Rows with NULL id take no part.  Rows stored twice under one id are one row.  The
    groups are aggregated first; only groups with copies meet the rows again, and AQE
    splits a group that holds a large share of them.
    """
    ids = _hashed(rows, keys, id_col, []).select("h", "h2", "sign", "copy_id").distinct()
    groups = ids.groupBy("h", "h2").agg(F.min("copy_id").alias("first_id"), F.count("*").alias("copies"), F.min("sign").alias("sign"), F.max("sign").alias("other")).where("copies > 1")
    several = groups.select("h", "h2", "sign", _unless(F.col("sign") != F.col("other"), "first_id", groups).alias("first_id"))
    # the same rows again: the shuffle is used twice
    return ids.join(several, ["h", "h2", "sign"]).where("copy_id <> first_id").select("first_id", "copy_id")
