"""Every stage of the corpus pipeline with nulls, long and repeated rows, and column names that clash."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paperloom.llm.mixing import mix_documents
from paperloom.llm.near_copies import drop_near_copies
from paperloom.llm.pieces import encode_pieces
from paperloom.llm.quality_rules import fit_quality, keep_quality
from paperloom.llm.repeats import cut_repeats, without_repeats

ODD = ["a.b", "a b", "key", "row", "doc", "carried", "label", "c0", "size", "digest", "copy", "spans", "n", "class_id", "position", "`tick"]


@pytest.fixture(scope="module")
def model(spark, sf):
    return fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


@pytest.fixture(scope="module")
def good(spark, sf, model):
    rows = keep_quality(spark.read.parquet(f"{sf}/documents.parquet"), model).orderBy("doc_id").limit(2).collect()
    return [r.text for r in rows]


@pytest.fixture(scope="module")
def odd(spark, good):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "word " * 20_000), (6, "x" * 100_000), (4, "one"), (None, "one"), (None, None), (9, good[0]), (8, good[0]), (9, good[0]), (10, good[1] + " more"), (None, good[1])]
    df = spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, None if t is None else len(t)) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ODD:
        df = df.withColumn(name.replace("`", ""), F.lit(name)) if "." not in name else df.select("*", F.lit(name).alias(name))
    return df


def sides(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


def test_quality(odd, model, good):
    out = keep_quality(odd, model)
    assert out.columns == odd.columns and sides(out.collect()) == sorted([(9, good[0]), (8, good[0]), (9, good[0]), (10, good[1] + " more"), (None, good[1])], key=repr)
    assert {r["a.b"] for r in out.collect()} == {"a.b"}


def test_near_copies(odd, good):
    out = drop_near_copies(odd).collect()
    left = sides(out)
    assert (8, good[0]) in left and (9, good[0]) not in left and left.count((4, "one")) == 2 and left.count((None, None)) == 1 and (None, good[1]) in left
    assert {r["a.b"] for r in out} == {"a.b"} and {r["a b"] for r in out} == {"a b"}


def test_passages(odd, good):
    out = without_repeats(odd)
    rows = out.collect()
    assert out.columns == odd.columns and len(rows) == odd.count()
    assert sorted(r["text"] for r in rows if r["doc_id"] == 9) == ["", ""] and [r["text"] for r in rows if r["doc_id"] == 8] == [good[0]]
    assert {r["a.b"] for r in rows} == {"a.b"} and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_largest_and_null_ids(spark, good):
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, good[0]), (None, good[1]), (1, good[1])], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_bytes) for r in cut_repeats(docs).collect()}
    assert got[top][0] == 0 and got[1][0] == 0 and got[None][0] == got[None][1] == len(good[1].encode())


def test_mixing_and_encoding(odd):
    mixed = mix_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    encoded = encode_pieces(odd, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(encoded) == odd.count()


def test_empty_tables(odd, model):
    none = odd.filter("false")
    for stage in (lambda d: keep_quality(d, model), drop_near_copies, without_repeats, mix_documents):
        assert stage(none).count() == 0 and stage(none).columns == odd.columns
    assert encode_pieces(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
