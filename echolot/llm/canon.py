"""Mapping free-entered values to a canonical list (problem 4).

The names of the reference entries stand in a BK-tree under the Damerau-Levenshtein
distance (the unrestricted one, a true metric).  Each typed value is brought to a plain
form and goes down the tree with a radius that grows with its length; the triangle
inequality prunes subtrees, and every name within the radius is found.  Of the names
found the nearest decide; the value is mapped if they belong to one entry only.

A value that is near no name is asked again with stretched letters once, then with outer
words left out, the fewest first; only words that stand in no name may be left out, and
the radius is then one less.  What then is near no name is read, in this order, as a name with repeated letters, a name without its vowels, the
beginning of a name, or other words around a whole name.

tier 0  the same letters and digits (case, accents, look-alikes, blanks, marks apart)
tier 1  within the radius
tier 2  within the radius, stretched letters once or unknown outer words left out
tier 3  the same when repeated letters count once
tier 4  the name without its vowels
tier 5  the beginning of a name (an abbreviation)
tier 6  the longest name whose words stand whole in the value, whatever other words are there
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textform import by_distinct, folded

NONE = "NONE"
#: A reference with more names is sharded instead of sent to every task.
MAX_BROADCAST_NAMES = 50_000
#: Beginnings of at least so many letters are read as abbreviations.
MIN_PREFIX = 5
#: Distinct values that meet a shard of a sharded reference in one group.
VALUES_A_GROUP = 50_000

_WORDS = re.compile(r"[^\W_]+")
_RUNS = re.compile(r"(.)\1+")
_STRETCHED = re.compile(r"(.)\1{2,}")
_VOWELS = re.compile(r"[aeiou]")


def spaced(text: str) -> str:
    """Words of a text in plain form, one blank between them."""
    bare = "".join(c for c in unicodedata.normalize("NFD", folded(text)) if not unicodedata.combining(c))
    return " ".join(_WORDS.findall(bare))


def devowelled(plain: str) -> set[str]:
    """A name without its vowels, with and without those that begin a word."""
    return {_VOWELS.sub("", plain).replace(" ", ""), "".join(w[0] + _VOWELS.sub("", w[1:]) for w in plain.split())}


def allowed_edits(length: int) -> int:
    """Edits within which a value of so many letters still means a name."""
    return 0 if length < 4 else 1 if length < 7 else 2


def edit_distances(name: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Damerau-Levenshtein distances of one name to a batch (rows of code points, 0 after the end), a row of the table at a time."""
    n, (rows, width) = len(name), codes.shape
    far = n + width
    table = np.full((n + 2, rows, width + 2), far, dtype=np.int16)
    steps = np.arange(width + 1, dtype=np.int16)
    table[1, :, 1:] = steps
    at = np.arange(rows)[:, None]
    last_row = np.zeros((rows, width), dtype=np.int16)
    last_col = np.zeros((rows, width), dtype=np.int16)
    row = np.empty((rows, width + 1), dtype=np.int16)
    for i, ch in enumerate(map(ord, name), 1):
        same = codes == ch
        above = table[i]
        # the last column before this one that holds the name's letter
        last_col[:, 1:] = np.maximum.accumulate(np.where(same, steps[1:], 0), axis=1)[:, :-1]
        swap = table[last_row, at, last_col] + (i - last_row + steps[1:] - last_col - 1)
        swap[(last_row == 0) | (last_col == 0)] = far
        row[:, 0] = i
        row[:, 1:] = np.minimum(np.minimum(above[:, 1:-1] + ~same, above[:, 2:] + 1), swap)
        # insertions: the least value to the left, one more for each step
        table[i + 1, :, 1:] = np.minimum.accumulate(row - steps, axis=1) + steps
        last_row[same] = i
    return table[n + 1, at[:, 0], lengths + 1]


def coded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names as rows of code points (0 after the end), and their lengths."""
    lengths = np.array([len(n) for n in names], dtype=np.int64)
    codes = np.zeros((len(names), max(int(lengths.max(initial=0)), 1)), dtype=np.int32)
    for i, n in enumerate(names):
        codes[i, : len(n)] = list(map(ord, n))
    return codes, lengths


class BKTree:
    """Burkhard-Keller tree over distinct strings; the root is the empty string, so its branches are lengths.

    Built a node at a time from all names below it, whose distances come in one batch.
    """

    def __init__(self, names: Iterable[str]):
        names = sorted(set(names) - {""})
        codes, lengths = coded(names)
        self.root: tuple[str, dict] = ("", {})
        open_ = [(self.root, lengths, np.arange(len(names)))]
        while open_:
            (_, children), dist, rows = open_.pop()
            for d in np.unique(dist).tolist():
                below = rows[dist == d]
                node = children[d] = (names[below[0]], {})
                rest = below[1:]
                if len(rest):
                    open_.append((node, edit_distances(node[0], codes[rest][:, : max(int(lengths[rest].max()), 1)], lengths[rest]), rest))

    def within(self, queries: list[str], radii: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(name, positions of queries within their radius, distances), every one."""
        codes, lengths = coded(queries)
        stack = [(child, np.flatnonzero(np.abs(lengths - d) <= radii)) for d, child in self.root[1].items()]
        while stack:
            (name, children), alive = stack.pop()
            if not len(alive):
                continue
            widest = max(int(lengths[alive].max()), 1)
            dist = edit_distances(name, codes[alive][:, :widest], lengths[alive])
            near = dist <= radii[alive]
            if near.any():
                yield name, alive[near], dist[near]
            for d, child in children.items():
                stack.append((child, alive[np.abs(dist - d) <= radii[alive]]))


class Reference:
    """The names of a shard of the reference: the tree, and what the readings beside it need."""

    def __init__(self, names: Iterable[tuple[str, str]]):
        self.exact: dict[str, set[str]] = {}
        self.single: dict[str, set[str]] = {}
        self.bare: dict[str, set[str]] = {}
        self.words: set[str] = set()
        for name, entry in names:
            plain = spaced(name)
            joined = plain.replace(" ", "")
            if not joined:
                continue
            self.words.update(plain.split())
            self.exact.setdefault(joined, set()).add(entry)
            self.single.setdefault(_RUNS.sub(r"\1", joined), set()).add(entry)
            for bare in devowelled(plain):
                if len(bare) > 1:
                    self.bare.setdefault(bare, set()).add(entry)
        self.sorted = sorted(self.exact)
        self.tree = BKTree(self.exact)
        self.longest = max(map(len, self.exact), default=0)

    def begun(self, start: str) -> set[str]:
        found: set[str] = set()
        for name in self.sorted[int(np.searchsorted(self.sorted, start)) :]:
            if not name.startswith(start):
                break
            found |= self.exact[name]
        return found

    def inside(self, plain: str) -> tuple[int, set[str]]:
        """(letters beside it, entries) of the longest name made of whole words of a spaced form that follow each other; a name said over and over fits nothing."""
        words, best, met = plain.split(), 0, []
        for i in range(len(words)):
            joined = ""
            for w in words[i:]:
                joined += w
                if len(joined) > self.longest:
                    break
                if len(joined) >= best and joined in self.exact:
                    met = [*met, joined] if len(joined) == best else [joined]
                    best = len(joined)
        entries = set().union(*map(self.exact.__getitem__, met)) if len(set(met)) == len(met) else set()
        return len(plain.replace(" ", "")) - best, entries

    def spans(self, plain: str) -> dict[int, list[str]]:
        """What is left of a spaced form when outer words that no name holds are left out, joined, by the number of words left out."""
        words = plain.split()
        known = [i for i, w in enumerate(words) if w in self.words]
        first, last = (known[0], known[-1] + 1) if known else (len(words), 0)
        found: dict[int, list[str]] = {}
        for i in range(min(first, len(words) - 1) + 1):
            length = 0
            for j in range(i + 1, len(words) + 1):
                length += len(words[j - 1])
                if length > self.longest + allowed_edits(length):
                    break
                if j >= last and j - i < len(words):
                    found.setdefault(len(words) - j + i, []).append("".join(words[i:j]))
        return found

    def nearest(self, forms: Iterable[str], less: int = 0) -> dict[str, tuple[int, set[str]]]:
        """(distance, names) of the nearest names of each form within its radius (less edits fewer): names at distance 0 first, the whole radius for the others."""
        best: dict[str, tuple[int, set[str]]] = {}
        radii = {f: max(allowed_edits(len(f)) - less, 0) for f in forms if f and len(f) <= self.longest + allowed_edits(len(f))}
        for exact in (True, False):
            open_ = [f for f in radii if f not in best and (exact or radii[f])]
            for name, at, dist in self.tree.within(open_, np.array([0 if exact else radii[f] for f in open_], dtype=np.int64)) if open_ else ():
                for i, d in zip(at.tolist(), dist.tolist()):
                    form = open_[i]
                    if form not in best or d < best[form][0]:
                        best[form] = (d, {name})
                    elif d == best[form][0]:
                        best[form][1].add(name)
        return best

    def entries(self, names: Iterable[str]) -> set[str]:
        return set().union(*map(self.exact.__getitem__, names))

    def winners(self, values: list[str]) -> pd.DataFrame:
        """(plain, tier, distance, begins, least, greatest): the best reading of each spaced form, with its first and last entry.

        begins: the form is the beginning of all the nearest names; all names that it begins
        then come as a row of tier 5 too, for the merge with other shards.
        """
        rows: list[tuple[str, int, int, bool, set[str]]] = []
        open_ = {plain: plain.replace(" ", "") for plain in values}

        def take(plain: str, tier: int, distance: int, found: set[str], begins: bool = False) -> None:
            rows.append((plain, tier, distance, begins, found))
            open_.pop(plain, None)

        near = self.nearest(open_.values())
        for plain, joined in list(open_.items()):
            if joined in near:
                d, found = near[joined]
                begins = d > 0 and len(joined) >= MIN_PREFIX and all(n.startswith(joined) for n in found)
                if begins or (d and len(joined) >= MIN_PREFIX and self.begun(joined)):
                    take(plain, 5, 0, self.begun(joined))
                take(plain, min(d, 1), d, self.entries(found), begins)
        once = {plain: form for plain, joined in open_.items() if (form := _STRETCHED.sub(r"\1", joined)) != joined}
        near = self.nearest(once.values())
        for plain, form in once.items():
            if form in near:
                take(plain, 2, near[form][0], self.entries(near[form][1]))
        spans = {plain: self.spans(plain) for plain in open_}
        for out in range(1, max((max(s, default=0) for s in spans.values()), default=0) + 1):
            asked = {plain: spans[plain][out] for plain in open_ if out in spans[plain]}
            near = self.nearest((f for fs in asked.values() for f in fs), 1)
            for plain, forms in asked.items():
                if met := [near[f] for f in forms if f in near]:
                    d = min(m[0] for m in met)
                    take(plain, 2, out * 100 + d, self.entries(n for m in met if m[0] == d for n in m[1]))
        for plain, joined in list(open_.items()):
            if not joined:
                continue
            cores = [joined, *(f for _, fs in sorted(spans[plain].items()) for f in fs)]
            beginnings = [joined] if len(joined) >= MIN_PREFIX else []
            for tier, look, forms in ((3, lambda c: self.single.get(_RUNS.sub(r"\1", c)), cores), (4, self.bare.get, cores), (5, self.begun, beginnings)):
                if found := next(filter(None, map(look, forms)), None):
                    take(plain, tier, 0, found)
                    break
            else:
                beside, found = self.inside(plain)
                if found:
                    take(plain, 6, beside, found)
        return pd.DataFrame([(p, t, d, b, min(f), max(f)) for p, t, d, b, f in rows], columns=["plain", "tier", "distance", "begins", "least", "greatest"])


_WINNERS = "plain string, tier int, distance int, begins boolean, least string, greatest string"


@F.pandas_udf(T.StringType())
def plain_form(values: pd.Series) -> pd.Series:
    """Spaced plain form of each distinct value; NULL stays NULL."""
    return by_distinct(spaced, values)


def mapped(plains: DataFrame, names: DataFrame) -> DataFrame:
    """(plain, entry, tier, distance) for the distinct spaced forms of plains.

    names: (name, entry) string columns of the reference; NULLs are left out.  entry is
    NONE where nothing fits or several entries fit equally well (tier then tells which
    reading was torn, NULL if nothing fitted).  '' and NULL fit nothing; with an empty
    reference everything is NONE.

    Distinct forms are resolved in parallel against a broadcast tree; a reference of more
    than MAX_BROADCAST_NAMES names is sharded by hash, each form meets every shard, and
    the shards' winners are merged.
    """
    distinct = plains.select("plain").where("plain IS NOT NULL").distinct()
    names = names.select(F.col("name").cast("string"), F.col("entry").cast("string")).where("name IS NOT NULL AND entry IS NOT NULL").distinct()
    head = names.limit(MAX_BROADCAST_NAMES + 1).collect()  # bounded
    if len(head) <= MAX_BROADCAST_NAMES:
        built = names.sparkSession.sparkContext.broadcast(Reference(tuple(r) for r in head))

        def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield built.value.winners(batch["plain"].tolist())

        # few bytes, much work: a partition per core, which AQE does not merge
        found = distinct.repartition(names.sparkSession.sparkContext.defaultParallelism, "plain").mapInPandas(resolve, _WINNERS)
    else:
        shards, salts = -(-names.count() // MAX_BROADCAST_NAMES), -(-distinct.count() // VALUES_A_GROUP) or 1
        left = distinct.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("salt", F.pmod(F.xxhash64("plain"), F.lit(salts)).cast("int"))
        right = names.withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def meet(values: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            return Reference(zip(part["name"], part["entry"])).winners(values["plain"].tolist())

        found = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(meet, _WINNERS)
    per_form = found.groupBy("plain").agg(F.collect_list(F.struct("tier", "distance", "begins", "least", "greatest")).alias("w"))  # two per shard at most
    best = F.array_min(F.transform("w", lambda x: F.struct(x["tier"].alias("tier"), x["distance"].alias("distance"))))
    per_form = per_form.withColumn("best", best).withColumn("top", F.filter("w", lambda x: (x["tier"] == F.col("best.tier")) & (x["distance"] == F.col("best.distance"))))
    beginnings = F.filter("w", lambda x: x["tier"] == 5)
    per_form = per_form.withColumn("w", F.when(F.forall("top", lambda x: x["begins"]), beginnings).otherwise(F.col("top")))
    least, greatest = F.array_min(F.col("w.least")), F.array_max(F.col("w.greatest"))
    per_form = per_form.select("plain", F.when(least == greatest, least).otherwise(NONE).alias("entry"), "best.tier", "best.distance")
    return distinct.join(per_form, "plain", "left").select("plain", F.coalesce("entry", F.lit(NONE)).alias("entry"), "tier", "distance")
