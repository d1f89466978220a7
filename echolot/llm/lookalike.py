"""Visually identical text with different characters (problem 2).

Method: compatibility normalisation to the composed form, mapped whitespace and
removal of default-ignorable characters, once per distinct value (``textform``),
optionally with full case folding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small
from .textform import consistent_col


def with_consistent_form(df: DataFrame, text_col: str, out_col: str = "consistent_form", case: str = "keep") -> DataFrame:
    """df with the consistent form of text_col as out_col.

    NULL text gives NULL, '' gives ''.  An existing column of the name out_col is replaced.
    Narrow: no shuffle, whole texts.
    """
    return df.withColumn(out_col, consistent_col(text_col, case))


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, case: str = "keep") -> DataFrame:
    """(id_a, id_b) of rows whose texts differ as stored but have one consistent form, id_a < id_b.

    Rows with NULL text or id take no part; texts equal as stored are no pair, a pair
    comes once (repeated rows add nothing); an empty table gives an empty result.

    Of two texts with one form at least one is not written in that form.  Such texts are
    found in one narrow pass and kept; the rows written in one of their forms join them by
    equality of text and form, without normalising again.  Of these rows different texts
    are paired, not rows, and pairs of texts then meet their rows.  The number of rows is
    that of the pairs asked for; ``lookalike_classes`` is the linear form.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    other = cut(rows.withColumn("form", consistent_col("text", case)).where("text <> form"))
    # a form is its own form
    told = other.unionByName(rows.join(small(other.select("form").distinct()), F.col("text") == F.col("form"))).distinct()
    texts = told.select("form", "text").distinct()
    pairs = texts.select("form", F.col("text").alias("text_a")).join(texts.select("form", F.col("text").alias("text_b")), "form").where("text_a <> text_b")
    left = told.select("form", F.col("text").alias("text_a"), F.col("id").alias("id_a")).join(pairs, ["form", "text_a"])
    return left.join(told.select("form", F.col("text").alias("text_b"), F.col("id").alias("id_b")), ["form", "text_b"]).where("id_a < id_b").select("id_a", "id_b").distinct()


def lookalike_classes(df: DataFrame, id_col: str, text_col: str, case: str = "keep") -> DataFrame:
    """(id, consistent_form, class_id, spellings): every row with the smallest id of its form.

    spellings is the number of different stored texts of the form.  Texts are first
    reduced to distinct (form, text) pairs with map-side combining, so that a form held by
    a large share of the rows reaches the join as few rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("consistent_form", consistent_col("text", case))
    classes = (
        rows.groupBy("consistent_form", "text")
        .agg(F.min("id").alias("least"))
        .groupBy("consistent_form")
        .agg(F.min("least").alias("class_id"), F.count("*").alias("spellings"))
    )
    return rows.join(classes, "consistent_form").select("id", "consistent_form", "class_id", "spellings")
