import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from paperloom.llm.pieces import PieceTransducer, decode_pieces, encode_pieces
from paperloom.llm.spm import MergeCounter, PieceModel, merged
from paperloom.llm.token_counts import read_model, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return PieceModel(read_model(PATH))


@pytest.fixture(scope="module")
def texts(spark, sf):
    random.seed(4)
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    odd = ["", " ", "\n", " " * 40 + "x", "▁▁ a ▁", "é\x00x", "日本語😀😀", "<s> </s> <unk> <0x41>", "a" * 5000, "\t\r\n"]
    return real + odd + ["".join(random.choice(" \nabcdet▁é😀thinger 日") for _ in range(random.randint(1, 150))) for _ in range(500)]


def test_counts_equal_the_library(model, library, texts):
    counter = MergeCounter(model, 1000)
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_paths_equal_the_library(model, library, texts):
    machine = PieceTransducer(model, 1000)
    for text in texts:
        ids = np.frombuffer(machine.encode(text), "<i4")
        assert ids.tolist() == library.encode(text)
        assert machine.decode(ids) == library.decode(ids.tolist())


def test_path_equals_merging(model):
    random.seed(9)
    machine = PieceTransducer(model)
    for _ in range(300):
        unit = "▁" * random.randint(0, 40) + "".join(random.choice("thereinga") for _ in range(random.randint(0, 12)))
        if unit:
            assert machine.path(unit) == merged(unit, model.ranks)


def test_arcs_equal_merging(model):
    """Arc weights against merging both pieces' text, for pairs that do occur next to each other and others."""
    random.seed(12)
    machine = PieceTransducer(model)
    pieces = [p for p in model.ids if len(merged(p, model.ranks)) == 1]
    common = sorted(pieces, key=model.ranks.get)[:3000]
    pairs = [(random.choice(group), random.choice(group)) for group in (pieces, common) for _ in range(20_000)]
    pairs += [(p, p) for p in common] + [(p[:i], p[i:]) for p in common for i in range(1, len(p)) if p[:i] in machine.parts or p[i:] in machine.parts]
    pairs += [("▁" * i, "▁" * j + word) for i in range(1, 18) for j in range(18) for word in ("", "the", "a") if j or word]
    pairs = [(a, b) for a, b in pairs if len(merged(a, model.ranks)) == len(merged(b, model.ranks)) == 1]
    got = [machine.joins(a, b) for a, b in pairs]
    assert len(machine.irregular) < 50 and got == [merged(a + b, model.ranks) == [a, b] for a, b in pairs] and any(got) and not all(got)


def test_unigram_scores_equal_the_library():
    """A small unigram model written by hand, with byte fallback."""

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    field = lambda n, raw: varint(n << 3 | 2) + varint(len(raw)) + raw
    number = lambda n, value: varint(n << 3) + varint(value)
    random.seed(13)
    words = ["▁", *"abcdefgh", "ab", "abc", "bc", "cd", "▁a", "▁ab", "de", "def", "fgh", "gh", "bcd", "▁bc", "hh", "aa", "aaa"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), *((w, -random.uniform(1, 9), 1) for w in words)]
    raw = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, k)) for p, s, k in pieces)
    raw += field(2, number(3, 1) + number(35, 1)) + field(3, field(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    machine = PieceTransducer(PieceModel(raw))
    for _ in range(2000):
        text = "".join(random.choice("abcdefgh aabcé日") for _ in range(random.randint(0, 25)))
        ids = np.frombuffer(machine.encode(text), "<i4").tolist()
        assert ids == library.encode(text), text
        assert machine.decode(np.array(ids, "<i4")) == library.decode(ids)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        PieceModel(b"")


def test_queries_on_edges(spark, documents, edge_texts, library):
    docs = documents(edge_texts)
    expected = sorted([(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in edge_texts], key=repr)
    assert sorted(map(tuple, token_counts(docs, PATH).collect()), key=repr) == expected
    encoded = encode_pieces(docs.withColumn("id", F.lit("clash")), PATH)
    assert sorted([(r.doc_id, r.n_tokens) for r in encoded.collect()], key=repr) == sorted([(i, n) for i, _, n, _ in expected], key=repr)
    assert all(r.round_trip for r in encoded.collect())
    back = {r.doc_id: r.text for r in decode_pieces(encoded.filter("doc_id = 5"), PATH).collect()}
    assert back == {5: "word " * 30_000}
    assert token_counts(documents([]), PATH).count() == 0 == encode_pieces(documents([]), PATH).count()
