import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.config import Config
from paperloom.operators import embedders
from paperloom.operators.embedders import Embedder, embedded, vectors_of
from paperloom.operators.similarity import embed_and_compare, hashed_embedding, top_by_references
from paperloom.plans.pipeline import Pipeline


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos int, content string").withColumn("doc_id", F.lit("d"))


def test_letters_and_null_and_order(spark):
    texts = ["abBz", None, "", "é1 ", "zz" * 4000, "a"]
    got = {r.pos: r.content_embedding for r in embedded(rows_of(spark, texts).repartition(2), embedders.resolve("letters")).collect()}
    assert got[0][:2] == [1.0, 2.0] and got[0][25] == 1.0 and sum(got[0]) == 4
    assert sum(got[1]) == sum(got[2]) == sum(got[3]) == 0 and got[4][25] == 8000 and got[5][0] == 1
    assert embedded(rows_of(spark, []), embedders.resolve("letters")).collect() == []


def test_texts_of_like_length_go_together():
    seen = []

    def model(texts):
        seen.append([len(t) for t in texts])
        return np.array([[len(t)] for t in texts])

    sizes = np.random.default_rng(0).integers(0, 100, 50)
    assert vectors_of(model, ["x" * n for n in sizes], 1, 8)[:, 0].tolist() == sizes.tolist()
    assert [n for part in seen for n in part] == sorted(sizes) and max(map(len, seen)) == 8


def test_model_is_made_once_a_process(spark, tmp_path):
    log = str(tmp_path / "made")

    def factory():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: np.array([[len(t), 1] for t in texts])

    backend = Embedder(f"counted-{tmp_path.name}", 2, factory=factory)
    for _ in range(3):
        assert embedded(rows_of(spark, ["a", "bb"] * 50).repartition(6), backend).count() == 100
    embedded(rows_of(spark, ["a", "bb"] * 50).repartition(6), backend).collect()
    made = open(log).read().split()
    assert made and len(made) == len(set(made))


def test_wrong_width_is_an_error(spark):
    backend = Embedder("narrow", 3, factory=lambda: lambda texts: np.zeros((len(texts), 2)))
    with pytest.raises(Exception, match="width 3"):
        embedded(rows_of(spark, ["a"]), backend).collect()


def test_names(spark):
    assert embedders.resolve("no such").name == "hash"
    with pytest.raises(LookupError):
        embedders.resolve("no such", strict=True)
    rows = rows_of(spark, ["a b c a"])
    assert embedded(rows, embedders.resolve("hash")).first().content_embedding == rows.select(hashed_embedding(F.col("content"))).first()[0]


def test_pipeline_with_a_second_backend(spark):
    config = Config(top_n=1, embedding_reference="qqq", back_matter=("never seen",))
    docs = spark.createDataFrame([(1, "flow chemistry qqq\n\nzeb qqqqqq\n\nnothing"), (2, None)], "doc_id int, text string")
    by = replace(config, backends=config.backends | {"embed": "letters"})
    assert [r.content for r in Pipeline(by).process(docs)["embedded"].collect()] == ["zeb qqqqqq"]
    assert [r.content for r in Pipeline(config).process(docs)["embedded"].collect()] == ["flow chemistry qqq"]
    both = Pipeline(replace(by, abstract_reference="nothing")).top_by_references(Pipeline(by).preprocess(docs))
    assert {(r.reference, r.content, r.rank) for r in both.collect()} == {("experiment", "zeb qqqqqq", 1), ("abstract", "nothing", 1)}


def test_references_in_one_pass_with_a_partial_limit(spark):
    rows = rows_of(spark, ["x"] * 5).withColumn("s", F.col("pos").cast("double"))
    out = top_by_references(rows, {"up": F.col("s"), "down": -F.col("s")}, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1
    got = {(r.reference, r.rank): r.pos for r in out.collect()}
    assert got == {("up", 1): 4, ("up", 2): 3, ("down", 1): 0, ("down", 2): 1}
    assert "content_embedding" in embed_and_compare(rows, "x", embedder=embedders.resolve("letters")).columns
