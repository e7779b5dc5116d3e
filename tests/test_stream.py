import time

import pytest

from paperloom.config import Config
from paperloom.plans.pipeline import Pipeline
from paperloom.streaming.ingest import changed_documents, latest, read_text_stream, run_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_changed_documents_are_redone_over_two_restarts(rocks, tmp_path):
    spark = rocks
    source, out = tmp_path / "in", str(tmp_path / "out")
    pipeline = Pipeline(Config(top_n=2, gate_keywords=("yes",)))
    seen = []

    def go():
        docs = changed_documents(read_text_stream(spark, str(source)))
        run_stream(docs, pipeline, out, str(tmp_path / "check"), stage="embedded").awaitTermination()
        done = spark.read.parquet(f"{out}-documents")
        seen.append(sorted((r.doc_id) for r in done.collect()))

    put(source / "v1", "a.txt", "yes one\n\ntwo")
    put(source / "v1", "b.txt", "yes b")
    go()
    put(source / "v2", "a.txt", "yes one\n\ntwo")  # unchanged
    put(source / "v2", "c.txt", "c\n\nyes c")
    go()
    put(source / "v3", "a.txt", "yes three\n\nfour\n\nfive")  # changed
    put(source / "v3", "b.txt", "yes b")
    go()
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "a", "b", "c"]]
    texts = spark.createDataFrame([("a", "yes three\n\nfour\n\nfive"), ("b", "yes b"), ("c", "c\n\nyes c")], "doc_id string, text string")
    columns = ["doc_id", "pos", "content", "rank"]
    whole = pipeline.process(texts)["embedded"].select(columns)
    assert sorted(map(tuple, latest(spark, out).select(columns).collect())) == sorted(map(tuple, whole.collect()))


def test_state_expires(rocks, tmp_path):
    spark, seen = rocks, []
    put(tmp_path / "in" / "v1", "a.txt", "text")
    docs = changed_documents(read_text_stream(spark, str(tmp_path / "in")), 1)
    query = docs.writeStream.foreachBatch(lambda df, n: seen.extend((r.doc_id, r.version) for r in df.collect()))
    query = query.option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        for name, n in (("v2", 1), ("v3", 2)):
            until = time.time() + 60
            while len(seen) < n and time.time() < until:
                time.sleep(0.25)
            put(tmp_path / "in" / name, "a.txt", "text")  # the same, after its state is gone
    finally:
        query.stop()
    assert seen[0] == ("a", 1) and len(seen) >= 2 and all(s == ("a", 1) for s in seen)
