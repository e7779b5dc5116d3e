import pytest
from pyspark.sql import functions as F

from paperloom.config import Config
from paperloom.plans.pipeline import Pipeline
from paperloom.plans.runs import Run, Stage


def stages(broken=(), calls=None):
    def step(name):
        def run(*rows):
            (calls if calls is not None else []).append(name)
            if name in broken:
                raise RuntimeError(name)
            out = rows[0]
            for more in rows[1:]:
                out = out.unionByName(more)
            return out.withColumn("content", F.concat("content", F.lit(name)))

        return run

    return [Stage("a", ("docs",), step("a")), Stage("b", ("a",), step("b")), Stage("c", ("a", "b"), step("c")), Stage("d", ("c",), step("d"))]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("x",), (None,), ("é",)], "content string")


def test_only_results_are_left_and_counts_stay(spark, docs, tmp_path):
    run = Run(spark, str(tmp_path / "run"), stages())
    out = run.go(docs=docs)
    assert sorted((r.content for r in out["d"].collect()), key=repr) == sorted(["xacd", "xabcd", None, None, "éacd", "éabcd"], key=repr)
    assert [n.split("-")[0] for n in run.folder.names()] == ["d", "manifest.json"]
    assert run.metrics()["a"] == {"n_rows": 3, "n_lines": 6, "n_bytes": 2 + 3 + 6} and run.metrics()["c"]["n_rows"] == 6


def test_a_broken_run_goes_on(spark, docs, tmp_path):
    path, calls = str(tmp_path / "run"), []
    with pytest.raises(RuntimeError):
        Run(spark, path, stages(("c",), calls)).go(docs=docs)
    run = Run(spark, path, stages((), calls))
    assert sorted(n.split("-")[0] for n in run.folder.names()) == ["a", "b", "manifest.json"]
    (tmp_path / "run" / "c-dead").mkdir()
    assert run.go(docs=docs)["d"].count() == 6 and calls == ["a", "b", "c", "c", "d"]
    assert [n.split("-")[0] for n in run.folder.names()] == ["d", "manifest.json"]
    again = Run(spark, path, stages((), calls)).go(docs=docs)
    assert again["d"].count() == 6 and len(calls) == 5


def test_chosen_results_and_wrong_names(spark, docs, tmp_path):
    run = Run(spark, str(tmp_path / "run"), stages(), ("b",))
    assert set(run.go(docs=docs)) == {"b"} and set(run.metrics()) == {"a", "b"}
    assert [n.split("-")[0] for n in run.folder.names()] == ["b", "manifest.json"]
    calls = []
    more = Run(spark, str(tmp_path / "run"), stages((), calls), ("b", "d"))  # a was deleted, and d needs it
    assert more.go(docs=docs)["d"].count() == 6 and calls == ["a", "c", "d"]
    with pytest.raises(ValueError):
        Run(spark, str(tmp_path / "x"), stages(), ("no",))
    with pytest.raises(ValueError):
        Run(spark, str(tmp_path / "x"), stages() + stages())


def test_pipeline_run_equals_the_lazy_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    pipeline = Pipeline(Config(back_matter=("nicht",), top_n=2))
    run = pipeline.run(docs, str(tmp_path / "run"))
    lazy = pipeline.process(docs)
    for name in ("summarized", "overall"):
        columns = [c for c in lazy[name].columns if c != "summary"]
        assert sorted(map(repr, run.table(name).select(columns).collect())) == sorted(map(repr, lazy[name].select(columns).collect()))
    assert {n: m["n_rows"] for n, m in run.metrics().items()} == {n: lazy[n].count() for n in lazy}
    assert {n.split("-")[0] for n in run.folder.names()} == {"summarized", "overall", "manifest.json"}
