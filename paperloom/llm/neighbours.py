"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected on ``dims`` random directions with normal (2-stable) entries, so the
squared projected distance of a pair over its squared distance follows a chi-square law with
``dims`` degrees. Rows are dealt to cells by the upper levels of a kd-tree over the projections;
each cell holds a kd-tree of its own. A query takes projected neighbours nearest first and
verifies them on the original vectors, until the chi-square test says that a neighbour nearer
than the k-th found would have shown up before with probability ``certainty``.

The search has two rounds. In the first each query searches its own cell, for a bound; in the
second it visits every cell whose box passes the test with this bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored

LEAF = 32


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """For an even number of degrees, by its finite sum."""
    half = np.asarray(x, float) / 2
    total, term = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def stop_ratio(certainty: float, dims: int) -> float:
    """The chi-square quantile: projected over true squared distance beyond which a search ends."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        if chi_square_cdf(middle, dims) < certainty:
            low = middle
        else:
            high = middle
    return high


def directions(width: int, dims: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


class Cells:
    """The upper levels of a kd-tree, from a sample: split planes in heap order, and the box of
    each cell (infinite at the outside, so that every row lies in one)."""

    def __init__(self, points: np.ndarray, depth: int, dims: int):
        self.depth = depth
        self.axis = np.zeros(2**depth - 1, np.int64)
        self.at = np.zeros(2**depth - 1)
        self.low = np.full((2**depth, dims), -np.inf)
        self.high = np.full((2**depth, dims), np.inf)
        self._split(0, 0, points, np.full(dims, -np.inf), np.full(dims, np.inf))

    def _split(self, node: int, level: int, points: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.depth:
            cell = node - (2**self.depth - 1)
            self.low[cell], self.high[cell] = low, high
            return
        axis = int(np.ptp(points, axis=0).argmax()) if len(points) else level % points.shape[1]
        at = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.at[node] = axis, at
        left, right = high.copy(), low.copy()
        left[axis] = right[axis] = at
        self._split(2 * node + 1, level + 1, points[points[:, axis] < at], low, left)
        self._split(2 * node + 2, level + 1, points[points[:, axis] >= at], right, high)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        row = np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[row, self.axis[node]] >= self.at[node])
        return node - (2**self.depth - 1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared projected distance from each point to each cell's box."""
        gap = np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None])
        return (np.maximum(gap, 0) ** 2).sum(-1)


class Tree:
    """A kd-tree in leaves of at most LEAF rows, cut by rank, so equal points split evenly."""

    def __init__(self, points: np.ndarray):
        leaves, open_ = [], [np.arange(len(points))]
        while open_:
            rows = open_.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            axis = int(np.ptp(points[rows], axis=0).argmax())
            order = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
            open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        self.points = points
        self.rows = np.full((len(leaves), LEAF), -1)
        for i, rows in enumerate(leaves):
            self.rows[i, : len(rows)] = rows
        self.low = np.array([points[r].min(0) for r in leaves])
        self.high = np.array([points[r].max(0) for r in leaves])


def _cosines(queries: np.ndarray, rows: np.ndarray, query_norms: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Row sums, not a matrix product: equal vectors give equal bits wherever they stand."""
    return (queries * rows).sum(-1) / (query_norms * norms)


def search(tree: Tree, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, projected: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of up to k nearest rows of a cell for each query; -inf where there are fewer.

    Leaves are visited nearest first, all queries a step at a time. bounds: squared distance that
    a row must not exceed to matter (inf where none is known). Ties go to the smaller id.
    """
    n = len(queries)
    norms, query_norms = np.sqrt((vectors * vectors).sum(-1)), np.sqrt((queries * queries).sum(-1))
    scores, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    gap = np.maximum(np.maximum(tree.low[None] - projected[:, None], projected[:, None] - tree.high[None]), 0)
    far = (gap**2).sum(-1)
    order = np.argsort(far, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(len(tree.rows)):
        leaf = order[active, step]
        kth = np.minimum(bounds[active], np.maximum(0.0, 2 - 2 * scores[active, k - 1]) + 1e-9)
        go = far[active, leaf] <= ratio * kth  # chi_square_cdf(far / kth) is under the certainty
        active, leaf, kth = active[go], leaf[go], kth[go]
        if not len(active):
            break
        rows = tree.rows[leaf]
        near = ((tree.points[rows] - projected[active][:, None]) ** 2).sum(-1) <= ratio * kth[:, None]
        near &= (rows >= 0) & (ids[rows] != query_ids[active][:, None])
        at, column = np.nonzero(near)
        if not len(at):
            continue
        row = rows[at, column]
        query = active[at]
        score = _cosines(queries[query], vectors[row], query_norms[query], norms[row])
        touched = np.unique(at)
        table = np.full((len(touched), LEAF), -np.inf)
        named = np.full((len(touched), LEAF), np.iinfo(np.int64).max)
        place = np.searchsorted(touched, at)
        table[place, column], named[place, column] = score, ids[row]
        own = active[touched]
        every, names = np.concatenate([scores[own], table], 1), np.concatenate([found[own], named], 1)
        best = np.lexsort((names, -every), axis=1)[:, :k]
        scores[own], found[own] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)
    return scores, found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors scaled by a power of two to a largest component of 0.5 to 1: no bit of a cosine changes,
    and no square of a finite vector overflows or vanishes."""
    rows = np.asarray(column.flatten(), float).reshape(-1, width)
    _, exponent = np.frexp(np.abs(rows).max(1, initial=0.0))
    return np.ldexp(rows, -exponent[:, None])


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, dims: int = 24, certainty: float = 0.93, cell_rows: int = 8192, sample: int = 50_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return query_id, rank (from 1), vec_id and score (cosine, in double precision): the k
    nearest rows found for each query, without rows of its own id.

    The cells come from at most ``sample`` rows (those first by a hash of their id) and number at
    most 4096, so what is broadcast is bounded; every row is indexed. A cell with more than
    ``cell_rows`` rows, as of one very common vector, is dealt into parts by id. A task holds one
    part and streams the queries that visit it.

    Vectors that are null, empty, all zero or with null or non-finite components take no part; a
    vector is compared with those of its own width. Null ids take no part. Rows that share an id
    count once, by their best score; ties of scores go to the smaller id. Empty tables give an empty
    result; other columns are left out. Of very wide vectors a task holds ``cell_rows`` at a time.
    """

    def usable(df: DataFrame) -> DataFrame:
        vectors = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        finite = "id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(vector, x -> x <> 0)"
        return vectors.filter(finite)

    given, asked = usable(rows), usable(queries)
    widths = given.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect()
    found = [_nearest(given.filter(F.size("vector") == w), asked.filter(F.size("vector") == w), w, n, k, dims, certainty, cell_rows, sample) for w, n in widths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest(given: DataFrame, asked: DataFrame, width: int, total: int, k: int, dims: int, certainty: float, cell_rows: int, sample: int) -> DataFrame:
    """The search among vectors (id, vector) of one width."""
    spark = given.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plane = directions(width, dims)

    def project(vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.sqrt((vectors * vectors).sum(-1, keepdims=True))) @ plane

    ratio = stop_ratio(certainty, dims)
    depth = min(12, max(0, math.ceil(math.log2(max(1, total / cell_rows)))))
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = project(_matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], ["point"])

    # the driver gets ``dims`` numbers a sampled row
    picked = given.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").mapInArrow(projected, "point array<double>")
    chosen = np.array(picked.toPandas()["point"].tolist()).reshape(-1, dims)
    cells = spark.sparkContext.broadcast(Cells(chosen, depth, dims))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.value.of(project(_matrix(batch.column(1), width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["id", "vector", "cell"])

    shape = "id long, vector array<double>, cell long"
    index = stored(given.mapInArrow(celled, shape), "cells")
    loads = index.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("long").alias("parts"))
    load = spark.sparkContext.broadcast(dict(loads.collect()))  # at most 4096 cells
    index = index.join(F.broadcast(loads), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(0).alias("kind"), "id", "vector", F.lit(0.0).alias("bound"))

    def visits(bounded: bool):
        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    points = project(_matrix(part.column(1), width))
                    if bounded:
                        bound = np.asarray(part.column(2))
                        far = cells.value.distances(points)
                        at, cell = np.nonzero(far <= ratio * bound[:, None])
                    else:
                        bound = np.full(len(points), np.inf)
                        at, cell = np.arange(len(points)), cells.value.of(points)
                    share = np.array([load.value.get(int(c), 0) if bounded else min(1, load.value.get(int(c), 0)) for c in cell], np.int64)
                    at, cell = np.repeat(at, share), np.repeat(cell, share)
                    piece = np.arange(len(at)) - np.repeat(np.cumsum(share) - share, share)
                    took = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(piece), pa.array(np.ones(len(at), np.int32)), took.column(0), took.column(1), pa.array(bound[at])], ["cell", "part", "kind", "id", "vector", "bound"])

        return sent

    moved = "cell long, part long, kind int, id long, vector array<double>, bound double"

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, ids, vectors = None, [], None, None, None
        for batch in batches:
            cell, part, kind = (np.asarray(batch.column(i)) for i in range(3))
            step = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])]))
            for lo, hi in zip(step, np.append(step[1:], batch.num_rows), strict=True):
                if (cell[lo], part[lo]) != at:
                    at, held, tree = (cell[lo], part[lo]), [], None
                if kind[lo] == 0:
                    held.append((np.asarray(batch.column(3))[lo:hi], _matrix(batch.column(4).slice(lo, hi - lo), width)))
                    continue
                if tree is None:
                    if not held:
                        continue
                    ids, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
                    tree, held = Tree(project(vectors)), [(ids, vectors)]
                for a in range(lo, hi, 128):
                    span = batch.slice(a, min(128, hi - a))
                    query_ids, query = np.asarray(span.column(3)), _matrix(span.column(4), width)
                    scores, found = search(tree, ids, vectors, query, project(query), query_ids, np.asarray(span.column(5)), k, ratio)
                    one, two = np.nonzero(scores > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[one]), pa.array(found[one, two]), pa.array(scores[one, two])], ["query_id", "vec_id", "score"])

    def run(asking: DataFrame) -> DataFrame:
        both = index.unionByName(asking)
        return both.repartition(parts, "cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(searched, "query_id long, vec_id long, score double")

    first = run(asked.mapInArrow(visits(False), moved)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    # a query with fewer than k in its own cell has no bound yet and visits every cell
    bound = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 - 2 * F.col("worst")) + 1e-9).otherwise(F.lit(float("inf")))
    bounds = stored(first.select(F.col("query_id").alias("id"), bound.alias("bound")), "bounds")
    second = asked.join(bounds, "id", "left").select("id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    hits = run(second.mapInArrow(visits(True), moved)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
