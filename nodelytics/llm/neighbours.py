"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors are made of length 1, so that the largest cosine is the least Euclidean distance, and projected
onto ``PROJECTED`` Gaussian directions.  For two points at distance d, the squared projected distance
over d^2 follows the chi-square law with as many degrees of freedom.  A search therefore takes points in
the order of their projected distance, verifies each by its true cosine, and stops where the next
projected distance is so large that, at the k-th best distance found, a point as near as that would
lie within it with probability ``CONFIDENCE``: a neighbour is missed with probability 1 - CONFIDENCE at
most.

The kd-tree is global.  Its upper splits are medians of a bounded sample of projections (``SAMPLE``
rows, by a hash of the id); every row goes to a cell, and a cell that holds more than ``BLOCK`` rows is
dealt to several blocks.  A block holds its vectors and the lower tree over them.  A query is searched
twice: in its own cell, which gives a first bound of its k-th distance, then in all other cells whose
box the stopping test at that bound does not exclude, each search starting from the bound.  Inside a
block the nodes are taken in the order of their distance, and the test ends the search.

Equal vectors are one point with its least ids, as many as a result can need, so copies cost nothing;
queries with equal vectors are searched once.  Visits of a block are dealt to several tasks by their
number.

Vectors that are null, zero, or hold null or non-finite components take no part, neither do those of
another length than the commonest one (of lengths equally common, the shortest), nor rows without an
id.  With no others there are no rows; with fewer than k others all are given.  Rows equal in id
and vector are one; rows that repeat an id with another vector are candidates of their own.  Extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LARGE_ROWS, stash, table

K = 5
#: Directions (even, for the closed form of the test), and the probability of the stopping test.
PROJECTED, CONFIDENCE = 8, 0.98
#: Rows of the sample that gives the upper splits, at most; rows of a block; points of a leaf of its tree.
SAMPLE, BLOCK, LEAF = 262_144, 4096, 256
#: Sample rows a cell, at least.
SAMPLED_A_CELL = 16
#: Visits of a block that one task takes.
VISITS = 4096
SEED = 11


def chi_square(x: float, degrees: int = PROJECTED) -> float:
    """P(chi-square <= x) for an even number of degrees."""
    term = total = math.exp(-x / 2)
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - total


def stop_factor(confidence: float = CONFIDENCE, degrees: int = PROJECTED) -> float:
    """The ratio of squared projected to squared true distance at which the test stops."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < confidence:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < confidence else (low, mid)
    return high


def directions(length: int, degrees: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, length, degrees]).standard_normal((length, degrees))


# --- trees -----------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in breadth-first order: children of node i are 2i + 1 and 2i + 2; the last level's nodes are the leaves.

    ``axis`` and ``cut`` per inner node; ``low`` and ``high`` bound each leaf and inner node.
    """

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def inner(self) -> int:
        return len(self.axis)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of each point."""
        node = np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while self.inner and node[0:1].size and node[0] < self.inner:
            node = 2 * node + 1 + (points[rows, self.axis[node]] > self.cut[node])
        return node - self.inner

    def distance(self, point: np.ndarray, nodes: np.ndarray | slice) -> np.ndarray:
        """Squared distance of the boxes of nodes."""
        out = np.maximum(self.low[nodes] - point, 0) + np.maximum(point - self.high[nodes], 0)
        return (out * out).sum(axis=-1)


def build(points: np.ndarray, depth: int, tight: bool) -> tuple[Tree, list[np.ndarray]]:
    """A tree of 2^depth leaves split at medians along the widest axis, and the rows of each leaf.

    ``tight``: boxes are those of the points; else they fill the space.
    """
    inner, dims = 2**depth - 1, points.shape[1]
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    low, high = np.full((2 * inner + 1, dims), -np.inf), np.full((2 * inner + 1, dims), np.inf)
    rows: list[np.ndarray] = [np.arange(len(points))] + [np.zeros(0, np.int64)] * (2 * inner)
    for i in range(2 * inner + 1):
        mine = points[rows[i]]
        if tight and len(mine):
            low[i], high[i] = mine.min(axis=0), mine.max(axis=0)
        if i >= inner:
            continue
        if len(mine):
            axis[i] = np.argmax(mine.max(axis=0) - mine.min(axis=0))
            cut[i] = np.partition(mine[:, axis[i]], (len(mine) - 1) // 2)[(len(mine) - 1) // 2]
        left = mine[:, axis[i]] <= cut[i] if len(mine) else np.zeros(0, bool)
        rows[2 * i + 1], rows[2 * i + 2] = rows[i][left], rows[i][~left]
        if not tight:
            low[2 * i + 1 : 2 * i + 3], high[2 * i + 1 : 2 * i + 3] = low[i], high[i]
            high[2 * i + 1, axis[i]] = low[2 * i + 2, axis[i]] = cut[i]
    return Tree(axis, cut, low, high), rows[inner:]


@dataclass
class Block:
    """One block in a worker: unit vectors in the order of its leaves, and the tree over their projections."""

    vectors: np.ndarray
    ends: np.ndarray
    tree: Tree

    @classmethod
    def of(cls, vectors: np.ndarray, project: np.ndarray) -> tuple[Block, np.ndarray]:
        """The block, and the order in which it holds the rows."""
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        depth = max(0, math.ceil(math.log2(max(1, len(unit) / LEAF))))
        tree, leaves = build(unit @ project, depth, tight=True)
        order = np.concatenate(leaves)
        return cls(unit[order], np.append(0, np.cumsum([len(x) for x in leaves])), tree), order

    def search(self, point: np.ndarray, at: np.ndarray, k: int, bound: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, squared distances)`` of verified points, the nearest k at most.

        Nodes leave the heap in the order of their projected distance; the points of a leaf are verified
        together.  ``bound``: a squared k-th distance known before.
        """
        rows, found = np.zeros(0, np.int64), np.zeros(0)
        best = math.inf
        limit = bound * factor
        distance = self.tree.distance(at, slice(None)).tolist()
        heap = [(distance[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            if d > limit:
                break
            if node < self.tree.inner:
                for c in (2 * node + 1, 2 * node + 2):
                    if distance[c] <= limit:
                        heapq.heappush(heap, (distance[c], c))
                continue
            a, z = self.ends[node - self.tree.inner], self.ends[node - self.tree.inner + 1]
            far = np.maximum(0, 2 - 2 * (self.vectors[a:z] @ point))
            near = np.flatnonzero(far < best)
            if not len(near):
                continue
            rows, found = np.append(rows, near + a), np.append(found, far[near])
            if len(rows) > k:
                keep = np.argpartition(found, k - 1)[:k]
                rows, found = rows[keep], found[keep]
            if len(rows) == k:
                best = float(found.max())
                limit = min(limit, best * factor)
        return rows, found


# --- points ----------------------------------------------------------------------------------


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, vector array<double>)`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null")
    rows = rows.filter(~bad & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("length"))
    return rows.join(F.broadcast(common), F.size("vector") == F.col("length"), "left_semi")  # one row


def points(rows: DataFrame, k: int) -> DataFrame:
    """``(vector, ids)``: each different vector once, with its k + 1 least ids, ascending; enough for any result."""
    least = Window.partitionBy("vector").orderBy("vec_id")
    return rows.withColumn("r", F.dense_rank().over(least)).filter(F.col("r") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _projected(column: pa.Array, project: np.ndarray) -> np.ndarray:
    v = _matrix(column)
    return (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ project


def upper_tree(stored: DataFrame, project: np.ndarray) -> Tree:
    """Splits from medians of a bounded sample: a cell for each ``BLOCK`` points, as far as the sample goes."""
    n = stored.count()
    cells = min(-(-n // BLOCK), SAMPLE // SAMPLED_A_CELL)
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    if not depth:
        return build(np.zeros((0, project.shape[1])), 0, tight=False)[0]
    size = min(SAMPLE, n, max(4096, 64 * 2**depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(_projected(batch.column(0), project)), pa.list_(pa.float64()))], names=["p"])

    taken = stored.select("vector").filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int((1 << 30) * size / n))  # a share that holds about ``size`` rows, by hash
    sample = taken.mapInArrow(run, "p array<double>").limit(2 * size).toPandas()
    return build(np.array(sample["p"].tolist()).reshape(-1, project.shape[1]), depth, tight=False)[0]


def blocks_of(stored: DataFrame, tree: Tree, project: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Both stored: ``(cell, block, vectors, ids)``, the points of each cell in blocks, vectors as little-endian doubles; and ``(cell, blocks)``."""
    sent = stored.sparkSession.sparkContext.broadcast((tree, project))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, project = sent.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_projected(batch.column(0), project)), pa.int32()), *batch.columns], names=["cell", "vector", "ids"])

    dealt = stored.select("vector", "ids").mapInArrow(cell, "cell int, vector array<double>, ids array<long>")
    # a row a cell; the sample bounds the cells
    sizes = stash(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "cells")
    dealt = dealt.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int").alias("block"), "vector", "ids")

    def pack(part: pa.Table) -> pa.Table:
        vectors = _matrix(part.column("vector"))
        return pa.table([pa.array([part.column("cell")[0].as_py()], pa.int32()), pa.array([part.column("block")[0].as_py()], pa.int32()), pa.array([vectors.astype("<f8").tobytes()], pa.binary()), pa.array([part.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64())))], names=["cell", "block", "vectors", "ids"])

    packed = dealt.groupBy("cell", "block").applyInArrow(pack, "cell int, block int, vectors binary, ids array<array<long>>")
    return stash(packed, "blocks", **LARGE_ROWS), sizes


# --- searches --------------------------------------------------------------------------------


def _searched(visits: DataFrame, blocks: DataFrame, sizes: DataFrame, project: np.ndarray, length: int, k: int, factor: float) -> DataFrame:
    """``(point, vec_id, score)``: what the visited blocks have for each query point.

    ``visits``: ``(cell, point, vector, bound)``; all blocks of the cell are searched.
    """
    visits = visits.join(F.broadcast(sizes), "cell")
    # a row a cell; a cell of many visits is searched by several tasks
    busy = F.broadcast(stash(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("parts")), "visits"))
    dealt = visits.join(busy, "cell").withColumn("part", F.pmod(F.xxhash64("point", F.lit(1)), F.col("parts")).cast("int"))
    dealt = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "point", "vector", "bound")
    held = blocks.join(busy, "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vectors", "ids")
    sent = visits.sparkSession.sparkContext.broadcast(project)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            raw = np.frombuffer(right.column("vectors")[0].as_py(), "<f8").reshape(-1, length)
            ids = right.column("ids")[0].as_py()
            block, order = Block.of(raw, sent.value)
            norms = np.sqrt((raw * raw).sum(axis=1))
            asked = _matrix(left.column("vector"))
            lengths = np.sqrt((asked * asked).sum(axis=1))
            unit = asked / lengths[:, None]
            at = unit @ sent.value
            for i, (point, bound) in enumerate(zip(left.column("point").to_pylist(), left.column("bound").to_pylist(), strict=True)):
                rows, _ = block.search(unit[i], at[i], k + 1, bound, factor)
                for row in order[rows].tolist():
                    score = float((raw[row] * asked[i]).sum() / (norms[row] * lengths[i]))
                    out += [(point, v, score) for v in ids[row]]
        best = pd.DataFrame(out, columns=["point", "vec_id", "score"]).sort_values(["point", "score", "vec_id"], ascending=[True, False, True])
        best = best[best.groupby("point").cumcount() <= k]
        return pa.table([pa.array(best["point"], pa.int64()), pa.array(best["vec_id"], pa.int64()), pa.array(best["score"], pa.float64())], names=["point", "vec_id", "score"])

    keys = ["cell", "block", "part"]
    return dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, "point long, vec_id long, score double")


def nearest(df: DataFrame, asked: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found among the rows of ``df`` for each row of ``asked``, which are rows of ``df`` too; a row is not its own neighbour."""
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    stored = stash(points(rows, k), "points")
    first = stored.select(F.size("vector")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], result)
    length, factor = first[0], stop_factor(confidence)
    project = directions(length)
    tree = upper_tree(stored, project)
    blocks, sizes = blocks_of(stored, tree, project)
    mine = usable(asked, vec_id, vector).filter(F.size("vector") == length).distinct()
    # one search for equal query vectors; the point's number is its least id
    queries = stash(mine.groupBy("vector").agg(F.min("vec_id").alias("point")), "queries")
    sent = spark.sparkContext.broadcast((tree, project))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, project = sent.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_projected(batch.column(1), project)), pa.int32()), *batch.columns], names=["cell", "point", "vector"])

    own = queries.select("point", "vector").mapInArrow(home, "cell int, point long, vector array<double>").withColumn("bound", F.lit(float("inf")))
    begun = stash(_searched(own, blocks, sizes, project, length, k, factor), "home")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, project = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = _projected(batch.column(1), project)
            homes, bounds = tree.leaf(at), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                near = np.flatnonzero(tree.distance(at[i], slice(tree.inner, None)) <= bounds[i] * factor)
                near = near[near != homes[i]]
                again = pa.array(np.full(len(near), i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *(c.take(again) for c in batch.columns)], names=["cell", "point", "vector", "bound"])

    # a found list of k + 1 may hold the query itself, so its last one bounds the k-th of the others
    bound = begun.groupBy("point").agg(F.when(F.count(F.lit(1)) > k, 2 - 2 * F.min("score")).alias("bound"))
    further = queries.join(bound, "point", "left").select("point", "vector", F.coalesce(F.greatest("bound", F.lit(0.0)), F.lit(float("inf"))).alias("bound")).mapInArrow(others, "cell int, point long, vector array<double>, bound double")
    found = begun.unionByName(_searched(further, blocks, sizes, project, length, k, factor))
    # the best of each point, then of each query row of that vector, without the row itself
    falling = Window.partitionBy("point").orderBy(F.col("score").desc(), "vec_id")
    best = stash(found.withColumn("r", F.row_number().over(falling)).filter(F.col("r") <= k + 1).groupBy("point").agg(F.collect_list(F.struct("r", "vec_id", "score")).alias("best")), "best")
    answers = queries.join(best, "point").select("vector", "best")
    each = mine.withColumnRenamed("vec_id", "query_id").join(answers, "vector").select("query_id", F.filter("best", lambda b: b["vec_id"] != F.col("query_id")).alias("best"))
    ordered = F.slice(F.array_sort("best"), 1, k)
    return each.select("query_id", F.posexplode(ordered).alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))
