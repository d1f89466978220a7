"""Frequency of every distinct value or term (problem 3).

Vertical layout: for each term the identifiers of its records are kept as
compressed bitmaps (65,536 identifiers to a container: a sorted array of 16-bit
offsets while sparse, a bit set when dense), beside a counter of occurrences.
Containers are built map-side, merged by union, and the number of records is
read from their cardinality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textform import consistent_col

#: Offsets a container holds as an array; beyond, the bit set of 8 KiB is smaller.
SPARSE_MOST = 4096
#: Rows gathered in a task before they are combined.
COMBINE_ROWS = 400_000


def pack(offsets: np.ndarray) -> bytes:
    """Container of sorted distinct offsets (uint16)."""
    if len(offsets) <= SPARSE_MOST:
        return b"A" + offsets.astype("<u2").tobytes()
    bits = np.zeros(65536, dtype=np.uint8)
    bits[offsets] = 1
    return b"B" + np.packbits(bits).tobytes()


def union_size(containers) -> int:
    """Cardinality of the union of containers."""
    dense, sparse = None, []
    for c in containers:
        raw = np.frombuffer(c, dtype=np.uint8, offset=1)
        if c[:1] == b"B":
            dense = raw.copy() if dense is None else dense | raw
        else:
            sparse.append(raw.view("<u2"))
    if dense is None:
        return len(sparse[0]) if len(sparse) == 1 else len(np.unique(np.concatenate(sparse)))
    bits = np.unpackbits(dense)
    for s in sparse:
        bits[s] = 1
    return int(bits.sum())


def _combined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(frames, ignore_index=True)
    codes, terms = pd.factorize(rows["term"])
    kinds, kind_names = pd.factorize(rows["kind"])
    ids = rows["record"].to_numpy(dtype=np.int64)
    order = np.lexsort((ids, codes, kinds))
    codes, kinds, ids = codes[order], kinds[order], ids[order]
    chunk = ids >> 16
    start = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (kinds[1:] != kinds[:-1]) | (chunk[1:] != chunk[:-1])])
    end = np.r_[start[1:], len(ids)]
    offsets = (ids & 0xFFFF).astype(np.uint16)
    fresh = np.r_[True, (ids[1:] != ids[:-1])]
    fresh[start] = True
    sizes, containers = [], []
    for a, b in zip(start, end):
        part = offsets[a:b][fresh[a:b]]
        sizes.append(len(part))
        containers.append(pack(part))
    return pd.DataFrame({
        "kind": kind_names[kinds[start]], "term": terms[codes[start]], "chunk": chunk[start],
        "occurrences": end - start, "size": sizes, "records": containers,
    })


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= COMBINE_ROWS:
            yield _combined(held)
            held, n = [], 0
    if held:
        yield _combined(held)


@F.pandas_udf(T.LongType())
def _merged(lists: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else union_size(x) for x in lists], dtype="Int64")


def term_counts(terms: DataFrame) -> DataFrame:
    """(kind, term, occurrences, records) from rows (kind, term, record).

    record is a 64-bit integer; rows with NULL term or record are left out; repeated rows
    count as further occurrences of one record; an empty table gives an empty result.

    Tasks send one container per term and 65,536 identifiers, not one row per occurrence.
    Containers meet by (term, chunk), so a term held by a third of all records spreads
    over its chunks and no task gathers a whole term.
    """
    rows = terms.where("term IS NOT NULL AND record IS NOT NULL").select(F.coalesce("kind", F.lit("")).alias("kind"), "term", F.col("record").cast("long"))
    built = rows.mapInPandas(_build, "kind string, term string, chunk long, occurrences long, size long, records binary")
    chunks = built.groupBy("kind", "term", "chunk").agg(F.sum("occurrences").alias("occurrences"), F.max("size").alias("size"), F.collect_list("records").alias("lists"))
    several = F.size("lists") > 1
    chunks = chunks.select("kind", "term", "occurrences", F.when(several, _merged(F.when(several, F.col("lists")))).otherwise(F.col("size")).alias("records"))
    return chunks.groupBy("kind", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def value_term(col: Column | str) -> Column:
    """A whole value as a term: consistent form, lower case, blanks trimmed and run together; NULL if blank."""
    form = F.trim(F.regexp_replace(consistent_col(col, "lower"), r"\s+", " "))
    return F.when(form != "", form)


def word_terms(col: Column | str) -> Column:
    """Runs of two or more letters of a text, in lower case and the consistent form."""
    return F.regexp_extract_all(consistent_col(col, "lower"), F.lit(r"(\p{L}{2,})"), F.lit(1))


def marked(counts: DataFrame, totals: DataFrame, rare_at_most: int = 1, common_share: float = 0.05) -> DataFrame:
    """counts with mark: 'rare' at up to rare_at_most records, 'common' from common_share of the kind's records, else NULL.

    totals: (kind, total), one row per kind.  A term that is both (tiny collections) is 'rare'.
    """
    return counts.join(F.broadcast(totals), "kind").withColumn(
        "mark", F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") >= F.lit(common_share) * F.col("total"), "common")
    )
