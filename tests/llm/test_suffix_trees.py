import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from paperloom.llm import queries, suffix_trees
from paperloom.llm.suffix_trees import WINDOW, cut_windows, prefix_names, repeated_windows

COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def brute(rows):
    """(doc_id, n_words, n_removed, digest) by counting all windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(ws[i : i + WINDOW]) for ws in split for i in range(len(ws) - WINDOW + 1))
    out = []
    for (doc_id, _), ws in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(ws) - WINDOW + 1):
            if count[tuple(ws[i : i + WINDOW])] > 1:
                gone.update(range(i, i + WINDOW))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def passages(seed, n=120):
    """Documents of few different words that share passages at other places and in other surroundings."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "la", "le", "é", "日本", "x" * 70, f"w{rng.randrange(400)}"])
    shared = [[word() for _ in range(rng.choice([34, 35, 36, 60, 150]))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [[word() for _ in range(rng.randrange(60))], rng.choice(shared), [word() for _ in range(rng.randrange(20))], rng.choice(shared)]
        gap = rng.choice([" ", "\n", " \t "])
        rows.append((i, gap.join(w for p in parts[: rng.randrange(1, 5)] for w in p)))
    return rows + [(n + i, t) for i, (_, t) in enumerate(rows[:10])]


@pytest.mark.parametrize("seed", range(3))
def test_equals_counting_all_windows(spark, documents, seed):
    rows = passages(seed)
    assert found(cut_windows(documents(rows))) == brute(rows)


def test_crowded_groups_get_longer_prefixes(spark, documents, monkeypatch):
    rows = passages(9)
    monkeypatch.setattr(suffix_trees, "GROUP", 3)
    monkeypatch.setattr(suffix_trees, "REFINED", 2)
    assert found(cut_windows(documents(rows).repartition(3))) == brute(rows)


def test_small_flushes(spark, documents, monkeypatch):
    rows = passages(4)
    monkeypatch.setattr(suffix_trees, "FLUSH", 50)
    monkeypatch.setattr(suffix_trees, "RANGE_BYTES", 500)
    assert found(cut_windows(documents(rows))) == brute(rows)


def test_edges(spark, documents, edge_texts):
    assert found(cut_windows(documents(edge_texts))) == brute([(i, t) for i, t in edge_texts])
    assert cut_windows(documents([])).collect() == []


def test_one_text_repeats_itself(spark, documents):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{passage} gap {passage}"), (2, "x " * 35), (3, "y " * 36)]
    assert found(cut_windows(documents(rows))) == brute(rows)
    assert [r.n_removed for r in cut_windows(documents(rows)).orderBy("doc_id").collect()] == [80, 0, 36]


def test_other_columns_and_names(spark, documents):
    rows = documents(passages(2, 20)).withColumnRenamed("doc_id", "my id").withColumnRenamed("text", "the.text")
    for extra in ("key", "twice", "entries", "spans", "copy", "digest", "prefix"):
        rows = rows.withColumn(extra, rows.lang)
    out = cut_windows(rows, "my id", "the.text").withColumnRenamed("my id", "doc_id")
    assert found(out) == brute(passages(2, 20))


def test_subtree_and_names():
    texts = [" ".join(map(str, range(40))).encode(), " ".join(map(str, range(2, 40))).encode()]
    mask = repeated_windows(np.array([0, 0]), texts, np.array([5, 3]), np.array([6, 4]), np.array([False, False]))
    assert mask.tolist() == [False, False, True, True, True, True, True, True, True, True]
    marked = repeated_windows(np.array([0, 1]), texts, np.array([5, 3]), np.array([6, 4]), np.array([False, True]))
    assert marked.tolist() == [False] * 6 + [True] * 4
    hashes = np.arange(100, dtype=np.uint64) % np.uint64(50)
    for width in (1, 8, 17, 35):
        names = prefix_names(hashes, width)
        assert len(names) == 101 - width and names[0] == names[50] and len(set(names.tolist())) == 50
    assert not len(prefix_names(hashes[:3], 8))


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op11_suffix_trees']})").fetchall()
    assert found(queries.op11_suffix_trees(spark, sf)) == sorted(expected, key=repr)
