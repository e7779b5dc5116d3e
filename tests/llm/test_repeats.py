import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paperloom.llm.repeats import cut_repeats, without_repeats

LAST = 2**63 - 1


def brute(rows):
    first = {}
    for i, text in rows:
        raw, i = (text or "").encode(), LAST if i is None else i
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], LAST + 1), i)
    out, kept_texts = [], []
    for i, text in rows:
        raw, own = (text or "").encode(), LAST if i is None else i
        mark = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < own:
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(raw, mark, strict=True) if not m)
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
        kept_texts.append((i, kept.decode(errors="ignore")))
    return sorted(out, key=repr), sorted(kept_texts, key=repr)


def test_equal_to_brute_force(spark, documents):
    random.seed(5)
    word = lambda n: "".join(random.choice("abcdefgh é\n") for _ in range(n))
    passages = [word(n) for n in (49, 50, 51, 60, 83, 120, 400, 700)]
    rows = [(k, word(random.randint(0, 900))) for k in range(40)]
    for k in range(40, 110):
        text = word(random.randint(0, 300))
        for _ in range(random.randint(0, 3)):
            p, at = random.choice(passages)[random.choice([0, 0, 7]) :], random.randint(0, len(text))
            text = text[:at] + p + text[at:]
        rows.append((k, text))
    rows += [(160, "a" * 500), (161, "a" * 300), (162, "b" * 49), (163, "ab" * 200), (164, "ab" * 100), (165, None), (166, ""), (None, rows[70][1]), (None, None), (70, rows[70][1]), (71, rows[90][1]), (72, rows[72][1])]
    docs = documents(rows).repartition(5)
    expected, texts = brute(rows)
    assert sorted(map(tuple, cut_repeats(docs).collect()), key=repr) == expected
    cut = without_repeats(docs)
    assert cut.columns == docs.columns
    found = cut.collect()
    assert sorted([(r.doc_id, r.text) for r in found], key=repr) == texts and all(r.n_chars == len(r.text) for r in found)


def test_long_text_and_empty_table(spark, documents):
    random.seed(6)
    long = "".join(random.choice("abcdefghij ") for _ in range(600_000))
    docs = documents({1: long, 2: "x" + long[1000:500_000] + "y", 3: long[599_960:] + long[:60]})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in cut_repeats(docs).collect()}
    assert got == {1: (600_000, 0, 0), 2: (499_002, 499_000, 1), 3: (100, 60, 1)}
    assert cut_repeats(documents([])).count() == 0


def test_texts_that_agree_in_polynomial_hashes(spark, documents):
    """Difference patterns under which every polynomial hash modulo a power of two is the same."""
    pattern = [bin(i).count("1") & 1 for i in range(2048)]
    texts = {1: "".join("ab"[x] for x in pattern), 2: "".join("ba"[x] for x in pattern), 3: "x" * 60 + "".join("ab"[x] for x in pattern)}
    rows = list(texts.items())
    expected, _ = brute(rows)
    assert sorted(map(tuple, cut_repeats(documents(texts)).collect())) == expected


def test_crowded_anchors_and_small_flushes(spark, documents, monkeypatch):
    """One passage in many texts, over the number of entries that are held for an anchor."""
    import paperloom.llm.repeats as repeats

    random.seed(9)
    letters = lambda n: "".join(random.choice("abcdef ") for _ in range(n))
    line = letters(70)
    rows = [(i, letters(random.randint(0, 60)) + line[random.randint(0, 12) :] + letters(random.randint(0, 60))) for i in range(160)]
    rows += [(i, rows[i - 160][1]) for i in range(160, 190)] + [(7, rows[9][1]), (None, rows[3][1] + line), (None, line + rows[3][1]), (None, "q" * 90)]
    got = {}
    for crowd in (4, 40, 16_384):
        with monkeypatch.context() as m:
            m.setattr(repeats, "CROWD", crowd)
            got[crowd] = crowded_spans(repeats, rows, crowd)
    assert got[4] == got[40] == got[16_384] == brute_starts(rows)


def brute_starts(rows):
    first = {}
    for i, text in rows:
        raw, i = text.encode(), LAST if i is None else i
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], LAST + 1), i)
    return {(k, p) for k, (i, text) in enumerate(rows) for p in range(len(text) - 49) if first[text[p : p + 50].encode()] < (LAST if i is None else i)}


def crowded_spans(repeats, rows, crowd):
    """The steps on one task's rows, without Spark."""
    keys, docs, texts = pa.array(range(len(rows))), pa.array([LAST if i is None else i for i, _ in rows]), pa.array([t for _, t in rows])
    sent = list(repeats._sent(64)(iter([pa.RecordBatch.from_arrays([keys, texts], ["key", "text"])])))
    sent = pa.Table.from_batches(sent).sort_by("range").combine_chunks().to_batches()
    lists = {}
    for batch in repeats._by_row(repeats._ENTRY)(repeats._shared(iter(sent), 3)):
        lists.update(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    column = pa.array([lists.get(k) for k in range(len(rows))], pa.binary())
    ranked = list(repeats._cut_out(iter([pa.RecordBatch.from_arrays([keys, docs, texts, column], ["key", "doc", "text", "anchors"])]), 3))
    ranked = pa.Table.from_batches(ranked).sort_by([("r1", "ascending"), ("r2", "ascending")]).combine_chunks()
    found = list(repeats._ranked(iter(ranked.to_batches(max_chunksize=7)), 3))
    single = [b.filter(pc.is_null(b.column(7))).select(range(7)) for b in found]
    single = pa.Table.from_batches(single).sort_by([(c, "ascending") for c in ("r1", "r2", "piece", "doc")]).combine_chunks()
    assert (single.num_rows > 0) == (crowd < 100)
    spans = [b.filter(pc.is_valid(b.column(7))).select(["key", "payload"]) for b in found] + list(repeats._alone(iter(single.to_batches(max_chunksize=5)), 3))
    starts = set()
    for batch in repeats._by_row(repeats._SPAN)(iter(spans)):
        for key, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for first, last in np.frombuffer(payload, repeats._SPAN):
                starts |= {(key, p) for p in range(first, last + 1)}
    return starts
