"""Mixing sources to target weights (problem 8).

Hierarchical budgeting: the token budget runs down a tree (source, language, ...)
by weight; what a node cannot supply goes to its siblings before its ancestors'
siblings.  Each leaf gives whole epochs of its documents and then a prefix of one
more epoch in a seeded order.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Leaves of the tree (combinations of level values with a target), checked.
MAX_LEAVES = 100_000
#: The seeded order of an epoch is cut into so many ranges; only one range of a leaf is sorted.
RANGE_BITS = 12


# How byte-level tokenizers part a text before they merge bytes.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose numbers of tokens a task remembers, and their letters at most.
MAX_PIECES, PIECE_LETTERS = 1_000_000, 64


class PieceCounts(dict):
    """Tokens of each piece met; a byte-level tokenizer never merges across pieces."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= PIECE_LETTERS:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = n
        return n


def counter(path: str):
    """Function that gives the tokens of each text of a list by the public tokenizer file at path."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    before = parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
        pieces, counts = regex.compile(PIECES), PieceCounts(tokenizer)
        return lambda texts: [sum(map(counts.__getitem__, pieces.findall(t))) for t in texts]
    return lambda texts: [len(e.ids) for start in range(0, len(texts), 256) for e in tokenizer.encode_batch(texts[start : start + 256], add_special_tokens=False)]


def token_count(path: str = TOKENIZER):
    """Arrow UDF: tokens of each text by the public tokenizer file at path; NULL and '' have none."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = globals().setdefault("_TOKENIZERS", {})
        if path not in cache:
            cache[path] = counter(path)
        codes, distinct = pd.factorize(texts)
        sizes = cache[path](list(distinct))
        return pd.Series([sizes[c] if c >= 0 else 0 for c in codes], dtype="int64")

    return count


def plain_name(col: Column | str) -> Column:
    """A hand-typed label in lower case, trimmed, blanks and dashes as '_'; NULL if blank."""
    col = F.col(col) if isinstance(col, str) else col
    name = F.regexp_replace(F.regexp_replace(F.lower(col), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}\-]+", "_")
    return F.when(name != "", name)


def fill(budget: float, weights: Sequence[float], caps: Sequence[float]) -> list[float]:
    """Shares of a budget by weight, none above its cap; what one cannot take goes to the others."""
    given = [0.0] * len(caps)
    open_ = [i for i in range(len(caps)) if weights[i] > 0 and caps[i] > 0]
    left = min(budget, sum(caps[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if given[i] + left * weights[i] / total >= caps[i] - 1e-9]
        if not full:
            for i in open_:
                given[i] += left * weights[i] / total
            break
        for i in full:
            left -= caps[i] - given[i]
            given[i] = caps[i]
        open_ = [i for i in open_ if i not in full]
    return given


def budgets(leaves: Mapping[tuple, float], weights: Mapping[tuple, float], total: float) -> dict[tuple, float]:
    """Budget of every leaf.  leaves: capacity by path; weights: of inner nodes or leaves by path, else the capacity.

    Top-down: a node's budget is filled into its children under their subtrees' whole
    capacity, so a shortage is met within a subtree before it leaves it.
    """
    capacity: dict[tuple, float] = {}
    children: dict[tuple, list[tuple]] = {}
    for path, cap in sorted(leaves.items()):
        for depth in range(len(path) + 1):
            node = path[:depth]
            if depth and node not in capacity:
                children.setdefault(node[:-1], []).append(node)
            capacity[node] = capacity.get(node, 0.0) + cap
    given = {(): min(total, capacity.get((), 0.0))}
    stack: list[tuple] = [()]
    while stack:
        node = stack.pop()
        kids = children.get(node, [])
        for kid, part in zip(kids, fill(given[node], [weights.get(k, capacity[k]) for k in kids], [capacity[k] for k in kids])):
            given[kid] = part
            stack.append(kid)
    return {path: given.get(path, 0.0) for path in leaves}


def mixed(docs: DataFrame, id_col: str, levels: Sequence[str], targets: DataFrame, total_tokens: int | None = None, seed: int = 7, even: Sequence[str] = ()) -> DataFrame:
    """(id, levels..., tokens, times, share): the documents of the mixture.

    docs has id, the level columns and tokens; targets has the first level's column,
    target_share and max_repeats.  total_tokens: size of the mixture; by default the
    largest at which every source of the targets that has documents reaches its share.
    even: levels whose values weigh alike within their parent; others weigh by what they
    hold.  What a value cannot supply goes to its siblings first, then to those of its
    parent.  times: uses of the document, 1 to max_repeats.  share: target_share.

    Documents without tokens, with a NULL id or with a first level that has no target take
    no part; NULL in further levels is a level value of its own.  A larger total than the
    sources can give is met as far as possible.  A source with a target and no documents
    leaves its share to the others.  Of rows with one id that with the most tokens counts.
    Empty tables give an empty result.

    One aggregation finds what each leaf holds (a bounded table on the driver).  The
    prefix of a leaf needs no sort of the leaf: sums over 4,096 ranges of the seeded hash
    show the range in which the budget ends, and only this range is ordered.  The document
    in which it ends is taken if most of it fits.
    """
    top = levels[0]
    goal = targets.where(f"{top} IS NOT NULL AND target_share > 0 AND max_repeats > 0").select(top, "target_share", "max_repeats").dropDuplicates([top])
    held = docs.where(F.col(id_col).isNotNull() & (F.col("tokens") > 0)).groupBy(id_col).agg(F.max(F.struct("tokens", *levels)).alias("_b"))
    rows = held.select(id_col, *[F.col(f"_b.{c}").alias(c) for c in levels], F.col("_b.tokens").alias("tokens")).join(F.broadcast(goal), top)  # one row per source
    rows = cut(rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels[1:]}))  # a row of numbers and labels for each document
    held = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.max("max_repeats").alias("max_repeats"), F.max("target_share").alias("target_share")).limit(MAX_LEAVES + 1).collect()
    if len(held) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: choose coarser levels")
    caps = {tuple(r[c] for c in levels): float(r["tokens"] * r["max_repeats"]) for r in held}
    weights = {(r[top],): float(r["target_share"]) for r in held}
    by_source: dict[str, float] = {}
    for path, cap in caps.items():
        by_source[path[0]] = by_source.get(path[0], 0.0) + cap
    whole = sum(weights.values())
    weights |= {path[: n + 1]: 1.0 for path in caps for n, c in enumerate(levels) if n and c in even}
    total = float(total_tokens) if total_tokens is not None else min((cap * whole / weights[(s,)] for s, cap in by_source.items()), default=0.0)
    given = budgets(caps, weights, total)
    plan = []
    for r in held:
        path = tuple(r[c] for c in levels)
        epochs = min(int(given[path] // r["tokens"] + 1e-9), r["max_repeats"])
        rest = given[path] - epochs * r["tokens"] if epochs < r["max_repeats"] else 0.0
        plan.append((*path, epochs, float(rest)))
    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in levels], T.StructField("epochs", T.IntegerType()), T.StructField("rest", T.DoubleType())])
    plan_df = F.broadcast(docs.sparkSession.createDataFrame(plan, schema))  # at most MAX_LEAVES rows
    rows = rows.join(plan_df, list(levels))
    # the position of a document in its leaf's next epoch
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "epochs", id_col)).withColumn("_range", F.shiftrightunsigned("_h", 64 - RANGE_BITS))
    sums = rows.where("rest > 0").groupBy(*levels, "_range").agg(F.sum("tokens").alias("_sum"))
    upto = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*levels).orderBy("_range")) - F.col("_sum"))
    rows = rows.join(upto, [*levels, "_range"], "left")
    inside = F.col("_before") + F.col("_sum") <= F.col("rest")
    split = (F.col("rest") > 0) & (F.col("_before") < F.col("rest")) & ~inside
    plainly = rows.where(~F.coalesce(split, F.lit(False))).withColumn("_more", F.when((F.col("rest") > 0) & inside, 1).otherwise(0))
    ending = rows.where(split).withColumn("_run", F.sum("tokens").over(Window.partitionBy(*levels, "_range").orderBy("_h", id_col)))
    ending = ending.withColumn("_more", F.when(F.col("_before") + F.col("_run") - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)).drop("_run")
    chosen = plainly.unionByName(ending).withColumn("times", F.col("epochs") + F.col("_more")).where("times > 0")
    return chosen.select(id_col, *levels, "tokens", "times", F.col("target_share").alias("share"))


def counted(docs: DataFrame, id_col: str, text_col: str, levels: Mapping[str, Column], tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, levels..., tokens) with the lineage cut: texts are tokenized once."""
    return cut(docs.select(F.col(id_col), *[c.alias(n) for n, c in levels.items()], token_count(tokenizer)(text_col).alias("tokens")))


def shares(mixture: DataFrame, docs: DataFrame, targets: DataFrame, top: str) -> DataFrame:
    """Per source of the targets: target and reached share, tokens held and used, tokens beyond the target, documents used, most uses of one document.

    tokens_over_target is negative for a source that was short and positive for one that
    took over what others were short of.
    """
    used = mixture.groupBy(top).agg(
        F.sum(F.col("tokens") * F.col("times")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("times").alias("most_uses")
    )
    held = docs.groupBy(top).agg(F.sum("tokens").alias("tokens_held"))
    rows = targets.select(top, "target_share", "max_repeats").join(held, top, "left").join(used, top, "left").na.fill(0, ["tokens_held", "tokens_used", "documents_used", "most_uses"])
    whole = rows.agg(F.sum("tokens_used").alias("_whole"))
    return rows.crossJoin(F.broadcast(whole)).select(  # one row
        top, "target_share", F.round(F.col("tokens_used") / F.nullif(F.col("_whole"), F.lit(0)), 6).alias("share_reached"),
        "max_repeats", "most_uses", "documents_used", "tokens_held", "tokens_used", F.round(F.col("tokens_used") - F.col("target_share") * F.col("_whole")).cast("long").alias("tokens_over_target"),
    )
