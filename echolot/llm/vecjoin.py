"""Most similar vectors for every vector (problem 5).

Block matrix join.  Space is cut into blocks by a k-d tree (fitted on a bounded
sample; every row is indexed).  A query meets only the blocks its search ball
touches.  Within a block, tiles of int8 codes are multiplied; the quantisation
error bound decides which pairs can still win, and only those are computed again
in float64.  Each tile keeps its k best per query and the tiles' winners are merged.

The search ball is max_distance where one is given; else the distance of the k-th
neighbour within the query's own block, so that the result is exact either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows the tree is fitted on: so many for each block, at least and at most about.
SAMPLE_A_BLOCK, MIN_SAMPLE, MAX_SAMPLE = 4, 8192, 2_000_000
#: Index rows a block should hold, and blocks at most (the tree is broadcast: some 20 bytes a block); beyond, blocks are cut into more tiles.
BLOCK_ROWS = 1024
MAX_BLOCKS = 524_288
#: Rows of either side in one tile; larger blocks are cut into several tiles.
TILE_ROWS = 4096
#: Queries multiplied at once within a tile.
STRIP_ROWS = 512


class BlockTree:
    """k-d tree by medians of the widest dimension: nodes as arrays, leaves numbered."""

    def __init__(self, sample: np.ndarray, blocks: int):
        self.dim: list[int] = []
        self.value: list[float] = []
        self.child: list[tuple[int, int]] = []  # negative: leaf -1 - number
        self.leaves = 0
        self.root = self._grow(sample, blocks)

    def _grow(self, rows: np.ndarray, blocks: int) -> int:
        widths = np.ptp(rows, axis=0) if len(rows) else np.zeros(1)
        if blocks < 2 or len(rows) < 2 or widths.max() <= 0:
            self.leaves += 1
            return -self.leaves
        d = int(widths.argmax())
        value = float(np.median(rows[:, d]))
        left = rows[:, d] <= value
        if left.all():  # the median is the maximum
            value = float(rows[rows[:, d] < value, d].max())
            left = rows[:, d] <= value
        at = len(self.dim)
        self.dim.append(d)
        self.value.append(value)
        self.child.append((0, 0))
        low = max(1, round(blocks * left.mean()))
        self.child[at] = (self._grow(rows[left], low), self._grow(rows[~left], max(1, blocks - low)))
        return at

    def touched(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row positions, blocks): each block that the ball around each row can touch."""
        at, blocks = [], []
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                at.append(rows)
                blocks.append(np.full(len(rows), -1 - node))
                continue
            v, r = x[rows, self.dim[node]], radius[rows]
            left, right = self.child[node]
            stack.append((left, rows[v - r <= self.value[node]]))
            stack.append((right, rows[v + r > self.value[node]]))
        return (np.concatenate(at), np.concatenate(blocks)) if at else (np.zeros(0, int), np.zeros(0, int))


def nearest_in_tile(q: np.ndarray, q_group: np.ndarray, x: np.ndarray, x_group: np.ndarray, x_id: np.ndarray, k: int, cap: float, q_id: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, index position, distance) of the k nearest of each query by (distance, id), at most cap away.

    Rows of one group (codes; -1: none) are no neighbours, nor is a row with the query's own id (q_id).
    """
    low = np.minimum(q.min(axis=0), x.min(axis=0))
    scale = max(float((np.maximum(q.max(axis=0), x.max(axis=0)) - low).max()) / 254, 1e-300)
    q8 = (np.rint((q - low) / scale) - 127).astype(np.int8)
    x8 = (np.rint((x - low) / scale) - 127).astype(np.int8)
    # int8 products and their sums stay below 2**24 for up to 256 dimensions, so float32 holds them exactly
    xf = x8.astype(np.float32)
    x_norm = (xf * xf).sum(axis=1)
    slack = math.sqrt(q.shape[1]) * 1.001 + 0.01  # each code is off by half a step at most, the difference by a step per dimension
    limit = cap / scale + slack
    out_q, out_x, out_d = [], [], []
    for start in range(0, len(q), STRIP_ROWS):
        part = q8[start : start + STRIP_ROWS].astype(np.float32)
        square = x_norm[None, :] + (part * part).sum(axis=1)[:, None] - 2 * (part @ xf.T)
        groups = q_group[start : start + STRIP_ROWS]
        square[(groups[:, None] == x_group[None, :]) & (groups[:, None] >= 0)] = np.inf
        if q_id is not None and (groups < 0).any():
            square[q_id[start : start + STRIP_ROWS][:, None] == x_id[None, :]] = np.inf
        most = np.full(len(part), min(limit * limit, 3e38), dtype=np.float32)
        if len(x) > k:
            kth = np.partition(square, k - 1, axis=1)[:, k - 1]
            most = np.minimum(most, (np.sqrt(np.maximum(kth, 0)) + 2 * slack) ** 2)
        rows, cols = np.nonzero(square <= most[:, None])
        keep = np.isfinite(square[rows, cols])
        rows, cols = rows[keep] + start, cols[keep]
        exact = np.sqrt(((q[rows] - x[cols]) ** 2).sum(axis=1))
        near = exact <= cap
        rows, cols, exact = rows[near], cols[near], exact[near]
        order = np.lexsort((x_id[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, rows, side="left")
        best = np.arange(len(rows)) - first < k
        out_q.append(rows[best])
        out_x.append(cols[best])
        out_d.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def usable(columns: list[Column]) -> Column:
    """Every feature known and finite, not all zero."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(fine, F.lit(False)) & (F.greatest(*[F.abs(c) for c in columns], F.lit(0.0)) > 0)


def _blocked(rows: DataFrame, tree, dims: int, radius: Column) -> DataFrame:
    """rows (id, grp, x0..) with a block column: once for each block that the ball touches."""
    xs = [f"x{i}" for i in range(dims)]
    schema = ", ".join(["id long", f"grp {dict(rows.dtypes)['grp']}", *[f"{x} double" for x in xs], "block int"])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, blocks = tree.value.touched(batch[xs].to_numpy(float), batch["r"].to_numpy(float))
            yield batch.iloc[at][["id", "grp", *xs]].assign(block=blocks.astype(np.int32))

    return rows.select("id", "grp", *xs, radius.cast("double").alias("r")).mapInPandas(spread, schema)


def _tiled(queries: DataFrame, index: DataFrame, dims: int, k: int, cap: float) -> DataFrame:
    """(query, neighbour, distance): winners of each tile."""
    xs = [f"x{i}" for i in range(dims)]
    # a block with many rows on either side is a grid of tiles; the counts are one row per block
    q_n = queries.groupBy("block").agg(F.count("*").alias("q"))
    x_n = index.groupBy("block").agg(F.count("*").alias("x"))
    grid = q_n.join(x_n, "block").select("block", F.ceil(F.col("q") / TILE_ROWS).cast("int").alias("q_parts"), F.ceil(F.col("x") / TILE_ROWS).cast("int").alias("x_parts"))
    grid = F.broadcast(grid)  # at most MAX_BLOCKS rows

    def cut(rows: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        rows = rows.join(grid, "block").withColumn(own[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        rows = rows.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select("block", "q", "x", F.lit(is_query).alias("is_query"), "id", "grp", *xs)

    both = cut(queries, "q_parts", "x_parts", True).unionByName(cut(index, "x_parts", "q_parts", False))

    def multiply(tile: pd.DataFrame) -> pd.DataFrame:
        # a row stored twice has one tile; it counts once
        tile = tile[~tile.duplicated(["is_query", "id"])]
        asks = tile["is_query"].to_numpy(bool)
        codes = pd.factorize(tile["grp"])[0]
        x, ids = tile[xs].to_numpy(float), tile["id"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        a, b, d = nearest_in_tile(x[asks], codes[asks], x[~asks], codes[~asks], ids[~asks], k, cap, ids[asks])
        return pd.DataFrame({"query": ids[asks][a], "neighbour": ids[~asks][b], "distance": d})

    return both.groupBy("block", "q", "x").applyInPandas(multiply, "query long, neighbour long, distance double")


def nearest(df: DataFrame, id_col: str, vector: list[Column], k: int, group_col: str, queries: Column | None = None, max_distance: float | None = None) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest rows of other groups for every query row.

    id_col: unique 64-bit integers (a row stored twice counts once).  queries: which rows
    ask (all by default); every usable row is searched.  Rows whose vector has a NULL, NaN
    or infinite part or is all zero neither ask nor answer.  A NULL group differs from
    every group.  Ties in distance go to the smaller id.  With max_distance only
    neighbours up to it count.  Fewer than k rows of other groups give fewer rows; an
    empty table gives none.

    Rows with one vector are reduced on the index side to those that can be among the k
    smallest ids for any asking group (at most k + 1 of a group and 2 k + 1 in all), so that a
    vector held by a third of all rows stays a few rows of a block.
    """
    dims, xs = len(vector), [f"x{i}" for i in range(len(vector))]
    points = df.where(F.col(id_col).isNotNull() & usable(vector))
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    points = points.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("grp"), asks.alias("asks"), *[c.cast("double").alias(x) for c, x in zip(vector, xs)])
    spark = df.sparkSession
    total = points.count()
    blocks = min(MAX_BLOCKS, max(1, -(-total // BLOCK_ROWS)))
    wanted = min(MAX_SAMPLE, max(MIN_SAMPLE, SAMPLE_A_BLOCK * blocks))
    drawn = points.select("grp", *xs).sample(fraction=min(1.0, wanted / max(total, 1)), seed=17).limit(2 * wanted).toPandas()  # bounded
    sample = drawn[xs].to_numpy(float).reshape(-1, dims)
    tree = spark.sparkContext.broadcast(BlockTree(sample, blocks))

    same = Window.partitionBy(*xs, "grp").orderBy("id")
    alike = Window.partitionBy(*xs).orderBy("id")
    index = points.withColumn("n", F.dense_rank().over(same)).where(F.col("n") <= k + 1).withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= 2 * k + 1)
    index = cut(_blocked(index, tree, dims, F.lit(0.0)))  # counted, then joined
    asking = points.where("asks")
    if max_distance is not None:
        found = _tiled(_blocked(asking, tree, dims, F.lit(float(max_distance))), index, dims, k, float(max_distance))
    else:
        first = _tiled(_blocked(asking, tree, dims, F.lit(0.0)), index, dims, k, float("inf"))
        reach = first.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("r"))
        # where a query's block has too few rows of other groups, a few thousand sampled rows bound the ball
        few = spark.sparkContext.broadcast((sample[:TILE_ROWS], drawn["grp"][:TILE_ROWS].tolist()))
        loose = asking.join(reach, asking["id"] == reach["query"], "left").withColumn("r", F.when(F.col("n") >= k, F.col("r"))).select("id", "grp", *xs, "r")
        schema = ", ".join(["id long", f"grp {dict(points.dtypes)['grp']}", *[f"{x} double" for x in xs], "r double"])

        def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows, groups = few.value
            for batch in batches:
                open_ = np.flatnonzero(batch["r"].isna())
                r = batch["r"].to_numpy(float, copy=True)
                if len(open_):
                    codes = pd.factorize(pd.Series([*batch["grp"].iloc[open_], *groups]))[0]
                    a, _, d = nearest_in_tile(batch[xs].to_numpy(float)[open_], codes[: len(open_)], rows, codes[len(open_) :], np.arange(len(rows)), k, float("inf"))
                    n = np.bincount(a, minlength=len(open_))
                    far = np.full(len(open_), np.inf)
                    last = np.zeros(len(open_))
                    np.maximum.at(last, a, d)
                    far[n >= k] = last[n >= k]
                    r[open_] = far
                yield batch.assign(r=r)

        asking = loose.mapInPandas(bounded, schema)
        found = _tiled(_blocked(asking, tree, dims, F.col("r") * (1 + 1e-12)), index, dims, k, float("inf"))
    winners = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbour"))), 1, k).alias("w"))  # k per tile
    return winners.select("query", F.posexplode("w").alias("rank", "w")).select("query", "w.neighbour", "w.distance", (F.col("rank") + 1).alias("rank"))


def mutual(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b: pairs in which each is a neighbour of the other."""
    a, b = F.least("query", "neighbour"), F.greatest("query", "neighbour")
    return neighbours.groupBy(a.alias("id_a"), b.alias("id_b")).agg(F.count("*").alias("n"), F.min("distance").alias("distance")).where("n = 2").drop("n")
