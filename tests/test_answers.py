import os

import pytest
from pyspark.sql import functions as F

from paperloom.config import Config
from paperloom.operators import backends, models
from paperloom.operators.answers import AnswerStore, digest_of
from paperloom.plans.pipeline import Pipeline


def counting(log, answer="A:"):
    """A backend that writes what it is asked to a file and fails on texts with 'bad', while asked to."""

    def factory():
        def run(prompts, contents, n):
            with open(log, "a") as f:
                for text in contents:
                    f.write(repr(text) + "\n")
            if any("bad" in c for c in contents) and os.path.exists(log + ".fail"):
                raise RuntimeError("no")
            return [answer + c for c in contents]

        return run

    return factory


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "asked"
    path.write_text("")
    return str(path)


def asked(log):
    return sorted(map(eval, open(log).read().split("\n")[:-1]))


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)


def answers(store, rows, backend, model="m", n=5):
    prompts = F.when(F.col("text").isNotNull(), F.concat(F.lit("p "), F.col("text")))
    return {r.id: (r._model.answer, r._model.error) if r._model else None for r in store.ask(rows, backend, prompts, F.col("text"), n, model).collect()}


def test_each_question_is_asked_once_over_rows_and_runs(spark, log, tmp_path):
    store, backend = AnswerStore(spark, str(tmp_path / "store")), counting(log)
    first = answers(store, rows_of(spark, ["x", "x", "y", None, "", "x"]), backend)
    assert first == {0: ("A:x", None), 1: ("A:x", None), 2: ("A:y", None), 3: None, 4: ("A:", None), 5: ("A:x", None)}
    assert asked(log) == ["", "x", "y"]
    again = answers(AnswerStore(spark, str(tmp_path / "store")), rows_of(spark, ["y", "z", "z"]), backend)
    assert again == {0: ("A:y", None), 1: ("A:z", None), 2: ("A:z", None)} and asked(log) == ["", "x", "y", "z"]
    answers(store, rows_of(spark, ["x"]), backend, model="other")
    answers(store, rows_of(spark, ["x"]), backend, n=6)
    assert asked(log).count("x") == 3
    assert answers(store, rows_of(spark, []), backend) == {}


def test_failures_are_kept_and_asked_again(spark, log, tmp_path):
    store, backend = AnswerStore(spark, str(tmp_path / "store")), counting(log)
    open(log + ".fail", "w").close()
    assert answers(store, rows_of(spark, ["bad", "good"]), backend) == {0: (None, "no"), 1: ("A:good", None)}
    os.remove(log + ".fail")
    assert answers(store, rows_of(spark, ["bad", "good"]), backend) == {0: ("A:bad", None), 1: ("A:good", None)}
    assert answers(store, rows_of(spark, ["bad"]), backend) == {0: ("A:bad", None)}
    before, folders = len(asked(log)), len(store._folders())
    os.mkdir(tmp_path / "store" / "broken")  # an append without its mark of success
    store.compact()
    assert len(store._folders()) == 1 < folders and store.rows().count() == 2
    assert answers(store, rows_of(spark, ["bad", "good"]), backend) == {0: ("A:bad", None), 1: ("A:good", None)}
    assert len(asked(log)) == before


def test_questions_do_not_run_together(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", None), (None, "a")], "p string, c string")
    digests = [r[0] for r in rows.select(digest_of("m", 1, F.col("p"), F.col("c"))).collect()]
    assert len(set(digests[:3])) == 3 and digests[3] is None
    assert rows.select(digest_of("m1", 1, F.col("p"), F.col("c"))).first()[0] != rows.select(digest_of("m", 11, F.col("p"), F.col("c"))).first()[0]


def test_pipeline_with_a_store_equals_one_without(spark, log, tmp_path):
    for stage in ("classify", "abstract", "summary", "overall"):
        backends.register(stage, "counting", counting(log, "Yes {} "))
    config = Config(backends=Config().backends | {s: "counting" for s in ("classify", "abstract", "summary", "overall")}, gate_keywords=("gated",))
    text = "one gated\n\ntwo\n\nthree"
    docs = spark.createDataFrame([(i, text if i < 4 else f"{text} {i}") for i in range(6)], "doc_id int, text string")
    plain = {k: sorted(map(tuple, v.select("doc_id", *[c for c in v.columns if c in ("pos", "abstract", "summarized", "overall", "error")]).collect()), key=repr) for k, v in Pipeline(config).process(docs).items()}
    open(log, "w").close()
    store = AnswerStore(spark, str(tmp_path / "store"))
    kept = {k: sorted(map(tuple, v.select("doc_id", *[c for c in v.columns if c in ("pos", "abstract", "summarized", "overall", "error")]).collect()), key=repr) for k, v in Pipeline(config, store).process(docs).items()}
    assert kept == plain
    first = len(asked(log))
    assert first == store.rows().count() < 24
    Pipeline(config, store).process(docs)["overall"].collect()
    assert len(asked(log)) == first


def test_plan_asks_after_the_fold(spark, log, tmp_path):
    """The model stands above the aggregation of equal questions, not on every row."""
    store = AnswerStore(spark, str(tmp_path / "store"))
    seen = []
    store._append = lambda found: seen.append(found._jdf.queryExecution().executedPlan().toString())
    store.ask(rows_of(spark, ["x", "x"]), counting(log), F.col("text"), F.col("text"), 5, "m")
    assert seen[0].index("ArrowEvalPython") < seen[0].index("Aggregate") and models.MODEL_ANSWER
