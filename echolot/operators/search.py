"""Full-text search over names: postings, query syntax, BM25."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75


def bare(text: str) -> str:
    """text without accents and other marks."""
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")


@F.pandas_udf(T.StringType())
def _bare(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    done = [bare(t) for t in distinct]
    return pd.Series([done[c] if c >= 0 else None for c in codes], dtype=object)


def unaccented(text: Column) -> Column:
    """text without accents; plain ASCII stays in the JVM."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(_bare(F.when(~plain, text)))


def tokens(text: Column) -> Column:
    """Letters and digits, lower case, without accents; '_' parts words."""
    return F.regexp_extract_all(unaccented(F.lower(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(docs: DataFrame, id_col: str, *text_cols: str) -> DataFrame:
    """(term, id, tf, length): the inverted index of the joined text columns."""
    words = tokens(F.concat_ws(" ", *text_cols))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(docs: DataFrame, index: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """(id, score): best documents for any of the terms, ties by id.

    Statistics are over all documents with a word; only the terms' postings are scored.
    """
    stats = index.groupBy("id").agg(F.first("length").alias("length")).agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    hits = index.where(F.col("term").isin([bare(t.lower()) for t in terms]))
    df = hits.groupBy("term").agg(F.count("*").alias("_df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # a row per query term; one row
    idf = F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("_avg")))
    return rows.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def matches(text: Column, query: str) -> Column:
    """Query syntax over a text column: words are all required; OR, NOT, "phrase", prefix*.

    AND is understood between words.  An empty query matches nothing.
    """
    words = tokens(text)
    padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

    def atom(piece: str) -> Column:
        plain = atoms(piece)
        if not plain:
            return F.lit(False)
        return F.contains(padded, F.lit(" " + " ".join(plain) + ("" if piece.endswith("*") else " ")))

    return condition(query, atom)


def atoms(piece: str) -> list[str]:
    """The words of one piece of a query, as ``tokens`` gives them."""
    return re.findall(r"[^\W_]+", bare(piece.lower()))


def condition(query: str, atom) -> Column:
    """The boolean Column of a query; atom gives that of a word, phrase or beginning."""
    either: list[Column] = []
    both: Column | None = None
    negate = False
    for piece in re.findall(r'"[^"]*"\*?|\S+', query):
        if piece == "AND":
            continue
        if piece == "OR":
            if both is not None:
                either.append(both)
            both = None
            continue
        if piece == "NOT":
            negate = True
            continue
        test = ~atom(piece) if negate else atom(piece)
        negate = False
        both = test if both is None else both & test
    if both is not None:
        either.append(both)
    out = F.lit(False)
    for e in either:
        out = out | e
    return F.coalesce(out, F.lit(False))


def well_formed(query: str) -> bool:
    """Quotes come in pairs, operators stand between words, and some word is asked for."""
    pieces = re.findall(r'"[^"]*"\*?|\S+', query)
    dangling = any(p in ("AND", "OR") and (i == 0 or i == len(pieces) - 1 or pieces[i - 1] in ("AND", "OR", "NOT")) for i, p in enumerate(pieces))
    return query.count('"') % 2 == 0 and not dangling and bool(pieces) and pieces[-1] != "NOT" and any(atoms(p) for p in pieces if p not in ("AND", "OR", "NOT"))


def hits(index: DataFrame, query: str) -> DataFrame:
    """(id): the documents that a query matches, read from the postings of its words only.

    A phrase counts where all its words stand (``matches`` over the found rows tells the
    order).  A query whose every part is negated would match what the postings do not
    show and finds nothing.
    """
    asked: dict[str, Column] = {}

    def atom(piece: str) -> Column:
        out = F.lit(True)
        plain = atoms(piece)
        for i, word in enumerate(plain):
            begins = piece.endswith("*") and i == len(plain) - 1
            name = f"{word}*" if begins else word
            asked[name] = F.col("term").startswith(word) if begins else F.col("term") == word
            out = out & F.array_contains("_held", name)
        return out if plain else F.lit(False)

    found = condition(query, atom)
    if not asked:
        return index.select("id").limit(0)
    any_of = F.lit(False)
    for test in asked.values():
        any_of = any_of | test
    told = F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in asked.items()]), lambda x: x.isNotNull()))
    held = index.where(any_of).select("id", told.alias("_name")).groupBy("id").agg(F.collect_set("_name").alias("_held"))  # at most the query's words
    return held.where(found).select("id")


def find(df: DataFrame, id_col: str, query: str, *text_cols: str, index: DataFrame | None = None) -> DataFrame:
    """Rows of df that a query matches; a query that is not well formed is looked for as it stands, as a part of any column.

    With an index only the rows it finds are read for phrases.
    """
    if not well_formed(query):
        low = query.strip().lower()
        test = F.lit(False)
        for c in text_cols:
            test = test | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(low)), F.lit(False))
        return df.where(test) if low else df.limit(0)
    rows = df if index is None else df.join(hits(index, query).withColumnRenamed("id", id_col), id_col, "left_semi")
    return rows.where(matches(F.concat_ws(" ", *text_cols), query))
