import re

import numpy as np
import public_tokenizers
import sentencepiece
from test_near_copies import brute as classes
from test_repeats import brute as cut

import corpus_pipeline
from paperloom.llm.queries import QUERIES


def test_stages_equal_brute_force(spark, sf):
    labels_path = sf
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 1500")
    columns = docs.columns
    kept = corpus_pipeline.quality(spark, docs, labels_path)
    assert kept.columns == columns
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert all(len(words(r.text)) >= 50 for r in kept.collect()) and 0.5 * docs.count() < kept.count()
    kept = spark.createDataFrame(kept.collect(), docs.schema)

    single = corpus_pipeline.near_dedup(spark, kept, sf)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted({c for c in classes(rows).values()})
    single = spark.createDataFrame(single.collect(), docs.schema)

    rows = [(r.doc_id, r.text) for r in single.collect()]
    unique = corpus_pipeline.passage_dedup(spark, single, sf)
    assert unique.columns == columns and sorted([(r.doc_id, r.text) for r in unique.collect()], key=repr) == cut(rows)[1]
    unique = spark.createDataFrame(unique.collect(), docs.schema)

    mixed = corpus_pipeline.mix(spark, unique, sf)
    total = sum(len(words(r.text)) for r in unique.collect())
    assert mixed.columns == columns and abs(sum(len(words(r.text)) for r in mixed.collect()) - total) <= 20
    mixed = spark.createDataFrame(mixed.collect(), docs.schema)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    encoded = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.encode(spark, mixed, sf).collect())
    assert encoded == sorted((r.doc_id, tuple(library.encode(r.text))) for r in mixed.collect())
    assert np.mean([len(i) for _, i in encoded]) > 10


def test_run_and_registry(spark, sf):
    import __spark_entry__ as entry

    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids" in out.columns
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
