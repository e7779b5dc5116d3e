import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from paperloom.llm import centroids, queries
from paperloom.llm.centroids import Bounds, centroid_clusters, integers

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
LONG = 1 << 63


def brute(rows, clusters=8, rounds=10):
    """Plain Lloyd rounds in Python's whole numbers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(Fraction(x) * 1024) for x in v], v))
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for _, v, _ in sorted(kept, key=lambda r: (name(r[0]), r[2]))[:clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))
    for _ in range(rounds):
        mine = [nearest(v) for _, v, _ in kept]
        for c in range(len(centres)):
            own = [v for (_, v, _), m in zip(kept, mine, strict=True) if m == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    mine = [nearest(v) for _, v, _ in kept]
    gaps = [square(v, centres[m]) for (_, v, _), m in zip(kept, mine, strict=True)]
    fits = lambda x: x if x < LONG else None
    total = {c: sum(g for g, m in zip(gaps, mine, strict=True) if m == c) for c in set(mine)}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, m, fits(g), fits(total[m]), fits(sum(gaps)), digests[m]) for (i, _, _), m, g in zip(kept, mine, gaps, strict=True)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def vectors(seed, n=300, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64))
    return [(i, (middle[i % 5] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("seed", "spread"), [(0, 1.0), (1, 0.1), (2, 5.0)])
def test_equals_plain_rounds(spark, seed, spread):
    rows = vectors(seed, spread=spread)
    assert found(centroid_clusters(frame(spark, rows).repartition(3))) == brute(rows)


def test_ties_repeats_and_left_out_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-1, 2, 64).astype(float).tolist()) for i in range(60)]
    rows += rows[:20] + [(7, [0.5] * 64), (7, [-0.5] * 64), (None, [0.25] * 64), (None, [0.25] * 64)]
    out = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [math.nan]), (105, [1.0] * 63 + [-math.inf])]
    assert found(centroid_clusters(frame(spark, rows + out))) == brute(rows)


def test_few_and_no_vectors(spark):
    rows = vectors(3, 5)
    assert found(centroid_clusters(frame(spark, rows))) == brute(rows)
    assert found(centroid_clusters(frame(spark, rows[:1]))) == brute(rows[:1])
    assert found(centroid_clusters(frame(spark, []))) == []
    assert found(centroid_clusters(frame(spark, [(1, None)]))) == []


def test_very_large_components(spark):
    rows = vectors(4, 40)
    for factor in (1e6, 1e15, 1e300):
        big = [(i, [x * factor for x in v]) for i, v in rows[:20]] + rows[20:]
        assert found(centroid_clusters(frame(spark, big), rounds=3)) == brute(big, rounds=3)


def test_other_columns_and_types(spark):
    rows = vectors(6, 50)
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id int, embedding array<float>").withColumnRenamed("vec_id", "my id").withColumnRenamed("embedding", "the.vector")
    for extra in ("block", "cluster", "ids", "vectors", "distance"):
        df = df.withColumn(extra, df["my id"])
    out = centroid_clusters(df, id_col="my id", vector_col="the.vector")
    assert dict(out.dtypes)["my id"] == "int"
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(out.withColumnRenamed("my id", "vec_id")) == brute(single)


def test_bounds_settle_most_vectors_and_never_wrongly():
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(8, 64)) * 4
    data = integers(np.concatenate([m + rng.normal(size=(200, 64)) for m in middle]))
    centres = integers(middle + rng.normal(size=(8, 64)))
    bounds = Bounds.unknown(len(data))
    bounds.scanned(data, np.arange(len(data)), centres)
    asked = 0
    for _ in range(6):
        after = np.stack([data[bounds.cluster == c].sum(axis=0) // max((bounds.cluster == c).sum(), 1) for c in range(8)])
        drift = np.sqrt(((after - centres) ** 2).sum(axis=1)) * (1 + 1e-9)
        centres = after
        bounds = bounds.loosened(drift)
        at = bounds.ambiguous(centres)
        bounds.scanned(data, at, centres)
        asked += len(at)
        assert (bounds.cluster == centroids.squared(data, centres).argmin(axis=1)).all()
    assert asked < 0.2 * 6 * len(data)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    expected = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op13_centroids']})").fetchall()
    assert found(queries.op13_centroids(spark, sf)) == sorted(expected, key=repr)
