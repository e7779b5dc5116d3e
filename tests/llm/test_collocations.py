import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from paperloom.llm import collocations as C
from paperloom.llm import queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, top=2000):
    """rows (lang, text): the same by plain counting."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in found.items():
        inside = [f for (other, longer), f in found.items() if other == lang and len(longer) > len(words) and any(longer[i : i + len(words)] == words for i in range(len(longer)))]
        if any(100 * f >= 80 * a for f in inside):
            continue
        cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, ranked = Counter(), []
    for lang, phrase, a, left, right, n, score in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            ranked.append((lang, ranks[lang], phrase, a, left, right, n, score))
    return ranked


def rows_of(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "\x01", "x\x00y", "日本", *[f"w{i}" for i in range(12)]]
    fixed = ["in spite of the", "new york city", "as well as"]
    out = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(40))]
        out.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", "; "]) for p in parts)))
    return out + [("en", None), ("en", ""), ("fr", " \t\n"), (None, "a b " * 500)]


def found(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_counting(spark, seed):
    rows = rows_of(seed)
    expected = brute(rows, 5)
    assert found(C.collocations(frame(spark, rows), least=5)) == sorted(expected) and len(expected) > 20
    assert found(C.collocations(frame(spark, rows), least=5, top=3)) == sorted(brute(rows, 5, 3))


def test_many_small_tries(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_WORDS", 40)
    monkeypatch.setattr(C, "FOLDED", 60)
    monkeypatch.setattr(C, "RANGE_BYTES", 100)
    monkeypatch.setattr(C, "blocks", lambda column: __import__("paperloom.llm.text", fromlist=["blocks"]).blocks(column, 200))
    rows = rows_of(7)
    assert found(C.collocations(frame(spark, rows).repartition(5), least=5)) == sorted(brute(rows, 5))


def test_empty_and_other_columns(spark):
    empty = frame(spark, [(None, None)]).filter("false")
    assert C.collocations(empty).collect() == []
    assert C.collocations(frame(spark, [("en", "one two three")])).collect() == []
    rows = frame(spark, rows_of(3)).withColumnRenamed("text", "a.text").withColumnRenamed("lang", "the lang")
    for extra in ("f", "phrase", "words", "n", "rank"):
        rows = rows.withColumn(extra, rows.doc_id)
    assert found(C.collocations(rows, least=5, text_col="a.text", lang_col="the lang")) == sorted(brute(rows_of(3), 5))


def test_long_text_in_one_piece(spark):
    rows = [("en", "to be or not " * 20_000)]
    assert found(C.collocations(frame(spark, rows))) == sorted(brute(rows, 30))


def test_filter_loses_no_entry():
    names = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = C.CHUNK_BITS * 2
    flags = np.zeros((2, C.CHUNK_BITS), bool)
    chunk, one, two = C.Filter.places(names, bits)
    flags[chunk, one] = flags[chunk, two] = True
    kept = C.Filter(bits, {i: np.packbits(f, bitorder="little").tobytes() for i, f in enumerate(flags)})
    assert kept.has(names).all() and kept.has(names + np.uint64(1)).mean() < 0.01


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op12_collocations']})").fetchall()
    assert found(queries.op12_collocations(spark, sf)) == sorted(expected)
