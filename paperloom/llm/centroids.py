"""Centroid clustering with Hamerly's bounds, in exact integers.

A vector is kept with one upper bound, of its distance to its own centroid, and one lower bound, of
its distance to the second nearest. When centroids move, the upper bound grows by the own centroid's
drift and the lower one shrinks by the largest drift. As long as the upper bound stays below the
lower one, or below half the way from its centroid to the next, the assignment stands and nothing is
computed. Every other vector is ambiguous and gets all of its distances, in whole numbers.

Vectors are stored once, packed in blocks of a partition's rows, in a table bucketed by block; a
round's assignments and bounds are another such table, so they meet without a shuffle. Each round is
written to the cluster's shared folder and the one before it deleted: a lost executor costs its
tasks of one round. A block sums its own clusters; what the driver gets in a round is one sum for
each centroid and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import bucketed, discard

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK_ROWS = 4096
#: Components below this are added and squared as 64-bit numbers; beyond, as Python's whole numbers.
FAST = 1 << 27
#: Bounds are doubles: a decision needs this much room, relative to the bounds.
MARGIN = 1e-9
_PACKED = "block long, ids binary, vectors binary"
_STATE = "block long, cluster binary, upper binary, lower binary, sums binary"
LONG = 1 << 63


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exact: 64-bit numbers where all are below FAST, else Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if not scaled.size or np.abs(scaled).max() < FAST:
        return scaled.astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
    return out


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors x centroids) squared distances, exact."""
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    out = np.empty((len(vectors), len(centroids)), vectors.dtype)
    for i, c in enumerate(centroids):
        gap = vectors - c
        out[:, i] = (gap * gap).sum(axis=1)
    return out


def _root(x: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinite where a double cannot hold the square."""
    if x.dtype != object:
        return np.sqrt(x.astype(np.float64))
    return np.array([math.isqrt(v) if v < 1 << 2000 else math.inf for v in x.ravel()], np.float64).reshape(x.shape) if x.size else x.astype(np.float64)


def array_of(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as a 64-bit array where they are below FAST, else as objects."""
    small = all(abs(v) < FAST for row in rows for v in row)
    return np.array(rows, np.int64 if small else object).reshape(len(rows), -1)


class Bounds:
    """Assignments of a block's vectors with their bounds."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.cluster, self.upper, self.lower = cluster, upper, lower

    @classmethod
    def unknown(cls, n: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n))

    def loosened(self, drift: np.ndarray) -> Bounds:
        """After the centroids moved by these distances."""
        return Bounds(self.cluster, (self.upper + drift[self.cluster]) * (1 + MARGIN), (self.lower - drift.max()) * np.where(self.lower > drift.max(), 1 - MARGIN, 1 + MARGIN))

    def ambiguous(self, centroids: np.ndarray) -> np.ndarray:
        """The vectors whose assignment the bounds do not settle."""
        apart = _root(squared(centroids, centroids))
        np.fill_diagonal(apart, np.inf)
        half = apart.min(axis=1) / 2
        room = np.maximum(self.lower, half[self.cluster]) * (1 - MARGIN)
        return np.flatnonzero(~(self.upper < room))

    def scanned(self, vectors: np.ndarray, at: np.ndarray, centroids: np.ndarray) -> None:
        """Assign these vectors anew by all of their distances; ties go to the smaller centroid."""
        if not len(at):
            return
        found = squared(vectors[at], centroids)
        self.cluster[at] = best = found.argmin(axis=1)
        own = found[np.arange(len(at)), best]
        self.upper[at] = _root(own) * (1 + MARGIN) + 1
        if len(centroids) > 1:
            other = _root(found)
            other[np.arange(len(at)), best] = np.inf
            self.lower[at] = np.maximum(other.min(axis=1) * (1 - MARGIN) - 1, 0)
        else:
            self.lower[at] = np.inf


def _kept(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(vec_id, vector of doubles) of the vectors that take part."""
    column = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), column.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter((F.size("vector") == width) & finite)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, vector) to blocks with numbers of their own. A null id is marked by a bit of a
    mask in front of the ids."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            ids = part.column(0)
            null = np.packbits(np.asarray(ids.is_null())).tobytes()
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([null + known.tobytes()], pa.binary()), pa.array([flat.astype(np.float64).tobytes()], pa.binary())], ["block", "ids", "vectors"])
            number += 1


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


def _ids(raw: bytes, n: int) -> pa.Array:
    mask = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8)), count=n).astype(bool)
    return pa.array(np.frombuffer(raw, np.int64, n, -(-n // 8)), mask=mask)


def _state(block: int, bounds: Bounds, vectors: np.ndarray, k: int) -> tuple:
    """A row of the state table, with the sums of its clusters as decimal text."""
    sums = []
    for c in range(k):
        mine = vectors[bounds.cluster == c]
        if len(mine):
            sums.append(f"{c}:{len(mine)}:" + ",".join(map(str, mine.sum(axis=0).tolist())))
    return block, bounds.cluster.astype(np.int32).tobytes(), bounds.upper.tobytes(), bounds.lower.tobytes(), ";".join(sums).encode()


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], before: list[list[int]] | None, width: int, scale: int) -> Iterator[pa.RecordBatch]:
    """A round: blocks (with the state of the round before, if any) to their new state."""
    now = array_of(centroids)
    drift = None if before is None else np.array([_root(squared(now[i : i + 1], array_of(before)[i : i + 1]))[0, 0] for i in range(len(now))]) * (1 + MARGIN) + (now.dtype == object)  # those roots are rounded down
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            vectors = integers(_unpacked(batch.column(1)[i].as_py(), width), scale)
            n = len(vectors)
            if drift is None:
                bounds = Bounds.unknown(n)
            else:
                kinds = (np.int32, np.float64, np.float64)
                bounds = Bounds(*(np.frombuffer(batch.column(2 + j)[i].as_py(), kind).copy() for j, kind in enumerate(kinds))).loosened(drift)
            at = np.arange(n) if drift is None else bounds.ambiguous(now)
            bounds.scanned(vectors, at, now)
            rows.append(_state(batch.column(0)[i].as_py(), bounds, vectors, len(now)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], ["block", "cluster", "upper", "lower", "sums"])


def _totals(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each cluster with vectors, over all blocks."""
    parts = state.select(F.explode(F.split(F.col("sums").cast("string"), ";")).alias("part")).filter("part <> ''")
    fields = F.split("part", ":")
    each = parts.select(F.get(fields, F.lit(0)).cast("int").alias("c"), F.get(fields, F.lit(1)).cast("decimal(38,0)").alias("n"), F.posexplode(F.split(F.get(fields, F.lit(2)), ",")).alias("d", "x"))
    # 18 digits at a time, so that no sum passes what a decimal holds
    digits = F.when(F.startswith("x", F.lit("-")), F.expr("substring(x, 2)")).otherwise(F.col("x"))
    sign = F.when(F.startswith("x", F.lit("-")), -1).otherwise(1)
    rows = each.select("c", "d", "n", sign.alias("sign"), F.reverse(digits).alias("digits"))
    rows = rows.select("c", "d", "n", "sign", F.posexplode(F.regexp_extract_all("digits", F.lit(r"\d{1,18}"), F.lit(0))).alias("place", "part"))
    value = F.col("sign").cast("decimal(2,0)") * F.reverse("part").cast("decimal(18,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    sums = rows.groupBy("c", "d", "place").agg(F.sum("n").alias("n"), F.sum(value.cast("decimal(28,0)")).alias("x")).collect()
    width = 1 + max((r.d for r in sums), default=-1)
    for r in sums:
        count, total = found.get(r.c, (0, [0] * width))
        total[r.d] += int(r.x) * 10 ** (18 * r.place)
        found[r.c] = (int(r.n) if r.d == 0 and r.place == 0 else count, total)
    return found


def _moved(centroids: list[list[int]], totals: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    return [[s // totals[c][0] for s in totals[c][1]] if c in totals else old for c, old in enumerate(centroids)]


def centroids_of(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame, list[list[int]]]:
    """(blocks, their last state, centroids) after ``rounds`` rounds and one more assignment."""
    kept = _kept(vectors, id_col, vector_col, width)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.withColumn("name", name).orderBy(F.asc_nulls_last("name"), "vector").limit(clusters).collect()
    centres = [[math.floor(Fraction(x) * scale) for x in r.vector] for r in first]
    blocks = bucketed(kept.mapInArrow(_packed, _PACKED), "block", "vectors")
    state, before = None, None
    for last in range(rounds + 1 if centres else 0):
        rows = blocks.select("block", "vectors")
        if state is not None:
            rows = rows.join(state.drop("sums").hint("shuffle_hash"), "block")
        after = bucketed(rows.mapInArrow(partial(_assigned, centroids=centres, before=before, width=width, scale=scale), _STATE), "block", "assignments")
        if state is not None:
            discard(state)
        state = after
        if last < rounds:
            before, centres = centres, _moved(centres, _totals(state))
    return blocks, state, centres


def centroid_clusters(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    A component x counts as the whole number floor(scale * x). The first centroids are the vectors
    with the least SHA-256 of ``seed:id``; each of ``rounds`` rounds assigns all vectors to the
    nearest (ties: the smaller number) and moves each centroid to the floor of its vectors' mean; one
    more assignment follows. distance is the squared one; sums are exact.

    Null vectors, vectors of another width and those with a null or a non-finite component take no
    part and give no row. Rows that repeat an id are vectors of their own (of equal ids those with
    the smaller components are first in line to be centroids); a null id is never first. Fewer
    vectors than ``clusters`` give as many centroids; an empty table gives an empty result. Numbers
    are never rounded, however large a component is; a distance or sum past a long is null. Other
    columns are left out.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    blocks, state, centres = centroids_of(spark, vectors, clusters, rounds, width, scale, seed, id_col, vector_col)
    if state is None:
        return spark.createDataFrame([], schema).withColumn("vec_id", F.col("vec_id").cast(kind)).withColumnRenamed("vec_id", id_col)

    def measured(batches: Iterator[pa.RecordBatch], sums_only: bool) -> Iterator[pa.RecordBatch]:
        at = array_of(centres)
        for batch in batches:
            for i in range(batch.num_rows):
                found = integers(_unpacked(batch.column(2)[i].as_py(), width), scale)
                cluster = np.frombuffer(batch.column(3)[i].as_py(), np.int32)
                gap = found.astype(object if at.dtype == object else found.dtype) - at[cluster]
                own = (gap * gap).sum(axis=1)
                if sums_only:
                    sums = [(c, str(sum(own[cluster == c].tolist()))) for c in np.unique(cluster).tolist()]
                    yield pa.RecordBatch.from_pylist([{"cluster": c, "total": s} for c, s in sums], pa.schema([("cluster", pa.int32()), ("total", pa.string())]))
                else:
                    distance = pa.array([x if x < LONG else None for x in own.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([_ids(batch.column(1)[i].as_py(), len(own)), pa.array(cluster), distance], ["vec_id", "cluster", "distance"])

    both = blocks.join(state.select("block", "cluster").hint("shuffle_hash"), "block")
    sums = both.mapInArrow(partial(measured, sums_only=True), "cluster int, total string")
    # a part of over 27 digits is past what a long could hold
    whole = F.sum(F.when(F.length("total") <= 27, F.col("total").try_cast("decimal(38,0)"))).alias("total")
    spoilt = F.max(F.length("total") > 27).alias("spoilt")
    found = {r.cluster: None if r.spoilt or r.total is None else int(r.total) for r in sums.groupBy("cluster").agg(whole, spoilt).collect()}
    inertia = None if None in found.values() else sum(found.values())
    fits = lambda x: x if x is not None and x < LONG else None
    stats = [(c, fits(found.get(c)), fits(inertia), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres)]
    named = spark.createDataFrame(stats, T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]))
    rows = both.mapInArrow(partial(measured, sums_only=False), "vec_id long, cluster int, distance long")
    out = rows.join(F.broadcast(named), "cluster")  # a row a centroid
    return out.select(F.col("vec_id").cast(kind).alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(table: str = "embeddings", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by DuckDB, all distances in every round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM {table}
WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1)::INT AS c, v FROM v ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {clusters})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT v.r, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM v, c{i} c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM d{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"u{i} AS (SELECT a.c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS k FROM a{i} a JOIN v USING (r))")
            parts.append(f"s{i} AS (SELECT c, k, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM u{i} GROUP BY c, k)")
            parts.append(f"m{i} AS (SELECT c, list(((s - (s % n + n) % n) // n) ORDER BY k) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(parts)}
SELECT v.vec_id, a.c AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c USING (c)"""
