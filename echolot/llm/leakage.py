"""Evaluation texts leaking into training text (problem 7).

Rare n-gram seeds join corpus documents to test items: of the n-grams of each window of
``min_run`` words of an item that any document holds, the SEEDS_A_WINDOW that fewest
documents hold are seeds, so every run of that length holds some, and so does an edited
copy that keeps n words in a row, mostly.  Documents and items that share a
seed are aligned word by word (Smith-Waterman), which also scores edited copies.
Copies edited too evenly to keep a seed are found by upper bounds of that score,
which no pair above the wanted share can miss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .textform import folded

#: Words of a seed.
SEED_WORDS = 6
#: Seeds of each window of an item.
SEEDS_A_WINDOW = 3
#: Candidate pairs up to which their ids are sent to the scan of the texts; more meet the texts by shuffle.
MAX_BROADCAST_PAIRS = 1_000_000
#: Distinct item n-grams that are sent to every task (8 bytes each); more are joined by shuffle.
MAX_BROADCAST_GRAMS = 2_000_000
#: About as many item words are sent to every task; more are sent one part of the items after another.
MAX_BROADCAST_WORDS = 2_000_000
#: Words of texts whose n-grams are made at once.
BATCH_WORDS = 500_000
#: Words times items up to which their uses are held as a table.
MAX_TABLE = 20_000_000
#: Smith-Waterman scores.
MATCH, MISMATCH, GAP = 2, -1, -1

_TAGS = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&[A-Za-z]{2,8};|&#\d{1,6};")
_WORDS = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[a-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words of a text: markup tags dropped, consistent form, case folded, punctuation and blanks as borders."""
    if not text:
        return []
    if text.isascii():
        # plain ASCII is its own consistent form but for blanks
        return _PLAIN.findall((_TAGS.sub(" ", text) if "<" in text or "&" in text else text).lower())
    return _WORDS.findall(folded(_TAGS.sub(" ", text)))


class Hashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash (int64) of each run of n word hashes."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64)
    total = np.zeros(len(codes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            total = total * _BASE + codes[j : len(codes) - n + 1 + j]
            total ^= total >> np.uint64(29)
    return total.view(np.int64)


def grams_of(texts: pd.Series, n: int, known: Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions of texts, hashes of the runs of n words in them), some BATCH_WORDS words at a time; no run crosses from one text to the next."""
    at = 0
    texts = texts.tolist()
    while at < len(texts):
        codes, lengths, first = [], [], at
        while at < len(texts) and len(codes) < BATCH_WORDS:
            words = words_of(texts[at])
            codes += map(known.__getitem__, words)
            lengths.append(len(words))
            at += 1
        grams = gram_hashes(np.array(codes, dtype=np.uint64), n)
        text = np.repeat(np.arange(first, at), lengths)
        whole = text[: len(grams)] == text[n - 1 : n - 1 + len(grams)]
        yield text[: len(grams)][whole], grams[whole]


def alignment(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(longest common run of words, best local alignment score) of two sequences of word codes."""
    longest = best = 0
    run = np.zeros(len(doc) + 1, dtype=np.int64)
    row = np.zeros(len(doc) + 1, dtype=np.int64)
    steps = np.arange(len(doc) + 1) * GAP
    for code in item:
        same = doc == code
        run[1:] = np.where(same, run[:-1] + 1, 0)
        longest = max(longest, int(run.max(initial=0)))
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(same, MATCH, MISMATCH), row[1:] + GAP), 0)
        # a gap along the document: the best start to the left, less its length
        new = np.maximum(np.maximum.accumulate(new - steps) + steps, new)
        row = new
        best = max(best, int(row.max(initial=0)))
    return longest, best


class Passages:
    """Items as word counts, to find those that a text may hold with at least min_share of their score."""

    def __init__(self, items: list[list[str]], min_share: float) -> None:
        self.codes: dict[str, int] = {}
        self.items = [np.array([self.codes.setdefault(w, len(self.codes)) for w in words], dtype=np.int64) for words in items]
        self.least = np.array([min_share * MATCH * len(i) - 1e-9 for i in self.items])
        counted = [np.unique(i, return_counts=True) for i in self.items]
        words = np.concatenate([w for w, _ in counted]) if counted else np.zeros(0, dtype=np.int64)
        order = np.argsort(words, kind="stable")
        self.holder = np.repeat(np.arange(len(counted)), [len(w) for w, _ in counted])[order]
        self.times = np.concatenate([n for _, n in counted])[order] if counted else words
        self.starts = np.searchsorted(words[order], np.arange(len(self.codes) + 1))
        # uses of each word in each item, as a table where that is small
        self.table = None
        if len(self.codes) * len(items) <= MAX_TABLE:
            self.table = np.zeros((len(self.codes), len(items)), dtype=np.int32)
            for i, (w, n) in enumerate(counted):
                self.table[w, i] = n

    def near(self, words: list[str]) -> list[int]:
        """Every item whose alignment with the text scores at least min_share, and few others.

        A score is at most MATCH for each word in common, and at most the best stretch of
        the text (or of the item) where a word in common counts MATCH and any other costs
        the cheaper of a mismatch and a gap.
        """
        text = np.fromiter(map(self.codes.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        held, n = np.unique(text[text >= 0], return_counts=True)
        if not len(held):
            return []
        if self.table is not None:
            shared = np.minimum(self.table[held], n[:, None]).sum(axis=0)
        else:
            spans = [slice(self.starts[w], self.starts[w + 1]) for w in held]
            holder = np.concatenate([self.holder[s] for s in spans])
            common = np.concatenate([np.minimum(self.times[s], k) for s, k in zip(spans, n)])
            shared = np.bincount(holder, common, len(self.items))
        found = np.flatnonzero(MATCH * shared >= self.least)
        return [int(i) for i in found if best_stretch(np.isin(text, self.items[i])) >= self.least[i] and best_stretch(np.isin(self.items[i], held)) >= self.least[i]]


def best_stretch(common: np.ndarray) -> int:
    """Largest sum of consecutive positions, MATCH where true and the least penalty elsewhere."""
    sums = np.concatenate(([0], np.cumsum(np.where(common, MATCH, max(MISMATCH, GAP)))))
    return int((sums - np.minimum.accumulate(sums)).max())


def near_pairs(doc: DataFrame, item: DataFrame, min_share: float, least_words: int) -> DataFrame:
    """(doc_id, item_id) of every pair whose alignment can be worth min_share of the item; items of fewer than least_words words left out.

    doc (doc_id, text), item (item_id, text).  Each text is compared with all items that it
    shares words with, whatever other documents hold.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share must be above 0 and at most 1")
    schema = f"doc_id {dict(doc.dtypes)['doc_id']}, item_id {dict(item.dtypes)['item_id']}"
    size = item.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    parts = -(-size // MAX_BROADCAST_WORDS) or 1

    def part(k: int) -> DataFrame:
        rows = item.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # bounded
        split = [(r["item_id"], words) for r in rows if len(words := words_of(r["text"])) >= least_words]
        sent = doc.sparkSession.sparkContext.broadcast(split)

        def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = [i for i, _ in sent.value]
            passages = Passages([w for _, w in sent.value], min_share)
            for batch in batches:
                pairs = [(d, ids[i]) for d, text in zip(batch["doc_id"], batch["text"]) for i in passages.near(words_of(text))]
                if pairs:
                    yield pd.DataFrame(pairs, columns=["doc_id", "item_id"])

        return doc.mapInPandas(found, schema)

    return reduce(DataFrame.unionByName, [part(k) for k in range(parts)])


def leaks(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, min_run: int = 12, seed_words: int = SEED_WORDS, min_share: float | None = None
) -> DataFrame:
    """(doc_id, item_id, longest_run, score, share): documents and the items they share a seed with.

    longest_run: most consecutive words in common.  score: Smith-Waterman; share: score by
    that of the whole item.  Every pair with a run of min_run words is among the rows, and
    with min_share every pair of at least that share; items shorter than min_run are
    matched in whole (min_run is then their length), items of fewer than seed_words words
    not at all.

    NULL or blank texts share nothing.  Rows stored twice give one row; where an id holds
    several texts the best counts.  Empty tables give an empty result.  Whole texts are
    read once to find the item n-grams in them, once with min_share to bound their scores
    (for each MAX_BROADCAST_WORDS item words), and once more for candidates only.
    """
    n = seed_words
    doc = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    item = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    doc_type, item_type = dict(doc.dtypes)["doc_id"], dict(item.dtypes)["item_id"]

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for batch in batches:
            for i, text in zip(batch["item_id"], batch["text"]):
                words = words_of(text)
                grams = gram_hashes(np.array([known[w] for w in words], dtype=np.uint64), n)
                if len(grams):
                    per_window = max(1, min(min_run, len(words)) - n + 1)
                    yield pd.DataFrame({"item_id": i, "pos": np.arange(len(grams)), "last": len(grams) - per_window, "width": per_window, "gram": grams})

    grams = cut(item.mapInPandas(item_grams, f"item_id {item_type}, pos long, last long, width long, gram long"))
    distinct = grams.select("gram").distinct()
    head = distinct.limit(MAX_BROADCAST_GRAMS + 1).toPandas()["gram"].to_numpy(np.int64)  # bounded
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(head) if len(head) <= MAX_BROADCAST_GRAMS else None)

    def doc_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        wanted = sent.value
        for batch in batches:
            for at, h in grams_of(batch["text"], n, known):
                if wanted is not None:
                    place = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                    told = wanted[place] == h if len(wanted) else np.zeros(len(h), dtype=bool)
                    at, h = at[told], h[told]
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "gram": h}).drop_duplicates()

    hits = doc.mapInPandas(doc_grams, f"doc_id {doc_type}, gram long")
    if len(head) > MAX_BROADCAST_GRAMS:
        hits = hits.join(distinct, "gram", "left_semi")
    hits = cut(hits.select("doc_id", "gram"))
    held = hits.groupBy("gram").agg(F.count("*").alias("docs"))
    # the rarest grams of each window, of those that a document holds: windows start at 0..last and hold width grams
    starts = F.sequence(F.greatest(F.col("pos") - F.col("width") + 1, F.lit(0)), F.greatest(F.least(F.col("pos"), F.col("last")), F.lit(0)))
    in_windows = grams.join(held, "gram").withColumn("start", F.explode(starts)).select("item_id", "start", "gram", "docs").distinct()
    window = Window.partitionBy("item_id", "start").orderBy("docs", "gram")
    seeds = in_windows.withColumn("n", F.row_number().over(window)).where(F.col("n") <= SEEDS_A_WINDOW).select("item_id", "gram").distinct()
    pairs = hits.join(seeds, "gram").select("doc_id", "item_id")
    if min_share is not None:
        pairs = pairs.unionByName(near_pairs(doc, item, min_share, n))
    pairs = cut(pairs.distinct())

    @F.pandas_udf("longest_run long, score long, share double")
    def aligned(texts: pd.Series, passages: pd.Series) -> pd.DataFrame:
        split: dict[str, list[str]] = {}
        rows = []
        for text, passage in zip(texts, passages):
            a = words_of(text)
            if passage not in split:
                if len(split) > 10_000:
                    split.clear()
                split[passage] = words_of(passage)
            b = split[passage]
            codes: dict[str, int] = {}
            both = np.array([codes.setdefault(w, len(codes)) for w in (*a, *b)], dtype=np.int64)
            longest, score = alignment(both[: len(a)], both[len(a) :])
            rows.append((longest, score, score / (MATCH * len(b)) if b else 0.0))
        return pd.DataFrame(rows, columns=["longest_run", "score", "share"])

    # texts of other documents go through no exchange
    sized = F.broadcast(pairs) if pairs.count() <= MAX_BROADCAST_PAIRS else pairs
    texts = doc.join(sized, "doc_id").join(item.withColumnRenamed("text", "passage"), "item_id")
    scored = texts.select("doc_id", "item_id", aligned("text", "passage").alias("a"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("a.longest_run").alias("longest_run"), F.max("a.score").alias("score"), F.max("a.share").alias("share"))
