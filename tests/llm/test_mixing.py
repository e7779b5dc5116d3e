import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm.mixing import mix_documents, mixture, training_order


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Water filling step by step: share by weight, stop at three times the size, reshare."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        each = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] >= 3 * sizes[s]]
        if not full:
            return out | {s: each * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    counts = {"a": 30, "b": 3, "c": 60, "é": 5, "z": 1, None: 8, "zz": 4}
    made, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            made.append((i, " ".join(["w"] * random.choice([0, 1, 7, 50, 300])), "en", source, 0))
            i += 1
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixture_equals_brute_force(docs, rows):
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    wanted = targets(sizes)
    got = {r.doc_id: r for r in mixture(docs).collect()}
    for source, total in sizes.items():
        own = sorted((r for r in rows if r[3] == source), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
        copies, rest = divmod(round(wanted[source]), total) if total else (0, 0)
        for i, text, *_ in own:
            size = size_of(text)
            cut = max(0, min(size, rest))
            rest -= cut
            r = got[i]
            assert abs(r.target - wanted[source]) < 1e-4 and (r.size, r.source_size, r.taken) == (size, total, copies * size + cut)
            assert r.taken <= 3 * size and (r.position is None) == (r.taken == 0)
    assert mixture(docs).select("doc_id", "taken", "position").exceptAll(mixture(docs.repartition(3)).select("doc_id", "taken", "position")).count() == 0


def test_order_and_copies(docs, rows):
    mixed = mixture(docs)
    order = training_order(mixed).collect()
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    assert [r.position for r in order] == sorted(r.position for r in order) and all(0 <= r.position <= 1 for r in order)
    sums = {}
    for r in order:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.copy_words
    assert sums == {k: v for k, v in taken.items() if v}
    made = mix_documents(docs)
    assert made.columns == docs.columns
    words = {}
    for r in made.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size_of(r.text)
    assert words == sums


def test_positions_follow_the_schedule(spark):
    """A heavy source grows over training, a light one fades."""
    rows = [(i, "w " * 10, "en", "abc"[i % 3], 0) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mean = {r.source: r.m for r in training_order(mixture(docs)).join(docs, "doc_id").groupBy("source").agg(F.avg("position").alias("m")).collect()}
    assert mean["a"] < mean["b"] < mean["c"]


def test_no_python_on_the_path(docs):
    plan = mixture(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(documents, edge_texts):
    docs = documents(edge_texts)
    got = mixture(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(got) == len(edge_texts) and sum(r.taken for r in got) == sum(size_of(t) for _, t in edge_texts)
    assert mixture(documents([])).count() == 0 and mixture(documents([(1, None), (2, "")])).filter("taken > 0").count() == 0
    assert mix_documents(documents([])).count() == 0


def test_null_and_repeated_ids_are_copied_each(documents):
    docs = documents([(None, "a b c d"), (None, "e f"), (1, "g h i"), (1, "j k l m n"), (1, "g h i"), (2, "o")])
    words = " ".join(r.text for r in mix_documents(docs).collect()).split()
    assert sorted(words) == sorted("a b c d e f g h i j k l m n g h i o".split())


def test_clashing_names_and_repeated_rows(spark, documents):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e f g"), (2, None), (3, "h")]
    docs = documents(rows).selectExpr("*", "doc_id AS _id", "1 AS _size", "2 AS key", "3 AS size", "4 AS copy", "text AS position", "5 AS row", "6 AS id")
    out = mix_documents(docs)
    got = out.collect()
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in got) == 11
    assert all((r._id, r.key, r.position) == (r.doc_id, 2, dict(zip((t for _, t in rows), (t for _, t in rows), strict=True)).get(r.position)) for r in got)
    assert mix_documents(docs.limit(0)).count() == 0
