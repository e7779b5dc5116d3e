import numpy as np
import pytest

from paperloom.llm.neighbours import Cells, Tree, chi_square_cdf, nearest, stop_ratio

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(ids, vectors, query, k=5):
    norms = np.sqrt((vectors * vectors).sum(1))
    i = list(ids).index(query)
    scores = (vectors[i] * vectors).sum(1) / (norms[i] * norms)
    order = [j for j in np.lexsort((ids, -scores)) if ids[j] != query][:k]
    return [(int(ids[j]), float(scores[j])) for j in order]


def test_chi_square():
    assert abs(chi_square_cdf(7.344, 8) - 0.5) < 1e-3 and abs(stop_ratio(0.95, 8) - 15.507) < 1e-2


def test_tree_and_cells_hold_every_row():
    points = np.random.default_rng(1).normal(size=(1000, 4))
    points[:400] = 1.0
    assert sorted(x for x in Tree(points).rows.ravel() if x >= 0) == list(range(1000))
    cells = Cells(points, 3, 4)
    own = cells.of(points)
    assert (cells.distances(points)[np.arange(1000), own] == 0).all()


@pytest.mark.parametrize("cell_rows", [8192, 100])
def test_recall(spark, sf, cell_rows):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = nearest(rows, rows.filter("vec_id % 10 = 0"), cell_rows=cell_rows).toPandas()
    table = rows.toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)
    hit = total = 0
    for query, found in got.groupby("query_id"):
        true = brute(ids, vectors, query)
        named = dict(zip(found.vec_id, found.score, strict=True))
        hit, total = hit + sum(named.get(v) == s for v, s in true), total + 5
        assert found.sort_values("rank")["rank"].tolist() == [1, 2, 3, 4, 5] and query not in named
    assert total == 5 * (ids % 10 == 0).sum() and hit / total >= 0.9


def test_share_of_rows_that_are_verified(spark, monkeypatch):
    """With the query's own parameters the stop spares half of the rows, at a recall of over 0.9."""
    import inspect

    from paperloom.llm import neighbours

    given = {k: p.default for k, p in inspect.signature(nearest).parameters.items()}
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)
    units = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    points = units @ neighbours.directions(vectors.shape[1], given["dims"])
    asked = np.flatnonzero(ids % 50 == 0)
    seen, inner = [], neighbours._cosines
    monkeypatch.setattr(neighbours, "_cosines", lambda q, r, a, b: (seen.append(len(q)), inner(q, r, a, b))[1])
    scores, found = neighbours.search(Tree(points), ids, vectors, vectors[asked], points[asked], ids[asked], np.full(len(asked), np.inf), 5, stop_ratio(given["certainty"], given["dims"]))
    share = sum(seen) / (len(asked) * len(ids))
    hit = sum(len({v for v, _ in brute(ids, vectors, q)} & set(f)) for q, f in zip(ids[asked].tolist(), found.tolist(), strict=True))
    print(f"share {share:.3f}, recall {hit / (5 * len(asked)):.3f}")
    assert share < 0.6 and hit / (5 * len(asked)) >= 0.9


def test_edges(spark):
    one = [0.0, 1.0]
    rows = [(1, one, 0), (2, one, 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [None, 1.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [1.0], 0), (None, one, 0), (9, [1.0, 1.0], 0), (2, one, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, nearest(df, df.filter("vec_id IN (1, 2, 3)")).collect()))
    assert [g[:3] for g in got] == [(1, 1, 2), (1, 2, 9), (2, 1, 1), (2, 2, 9)] and got[0][3] == 1.0
    assert nearest(df.limit(0), df).count() == 0 and nearest(df.filter("vec_id = 1"), df.filter("vec_id = 1")).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(300, 0, -1)], SCHEMA)
    got = nearest(df, df.filter("vec_id = 100"), cell_rows=50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]


def test_huge_and_tiny_vectors_and_other_widths(spark):
    rows = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [3e-320, 1e-320]), (4, [1.0, 2.0, 2.0]), (5, [1e300, 2e300, 2e300]), (6, []), (7, None)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in nearest(rows, rows.filter("vec_id IN (0, 4)")).collect()}
    assert got[0, 1] == (1, 1.0) and got[4, 1] == (5, 1.0) and {k for k in got if k[0] == 4} == {(4, 1)}
    assert all(abs(s) <= 1 + 1e-9 for _, s in got.values()) and {v for (q, _), (v, _) in got.items() if q == 0} == {1, 2, 3}
