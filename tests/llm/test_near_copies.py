import random
from collections import Counter

import numpy as np
import pyarrow as pa

from paperloom.llm.near_copies import Tokens, bags, banded_distance, crossing, drop_near_copies, near_copies, similar, sketch, tokens
from paperloom.llm.text import blocks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    random.seed(2)
    for _ in range(2000):
        a = [random.randint(0, random.choice([2, 6, 50])) for _ in range(random.randint(0, 30))]
        b = a[:]
        for _ in range(random.randint(0, 8)):
            if b and random.random() < 0.6:
                b[random.randrange(len(b))] = random.randint(0, 6)
            else:
                b.insert(random.randint(0, len(b)), random.randint(0, 6))
        limit, true = random.randint(0, 12), distance(a, b)
        assert banded_distance(a, b, limit) == min(true, limit + 1)


def sequences(texts):
    out = []
    for block in blocks(pa.array(texts)):
        found = tokens(block)
        out += [found.hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    return out


def test_words_ignore_case_and_marks():
    a, b, c, d = sequences(["Éa, The x.", "éa the X", "the éa x", "!!"])
    assert (a == b).all() and not (a == c).all() and len(d) == 0
    assert (sketch(a) == sketch(b)).all() and not (sketch(a) == sketch(c)).all() and len(sketch(d)) == 0


def test_sketches_follow_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**60, 400).astype(np.uint64)
    edited = words.copy()
    edited[::60] = 7
    swapped = np.concatenate([words[200:], words[:200]])
    agree = lambda x: (sketch(words, 400) == sketch(x, 400)).mean()
    assert agree(edited) > 0.3 and agree(swapped) < 0.75 < agree(words)


def brute(rows, least=0.8):
    words = sequences([t for _, t in rows])
    counts = [Counter(w.tolist()) for w in words]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            longer = max(len(words[i]), len(words[j]))
            # words that are not in both each cost an edit, which spares most alignments
            if rows[i][0] != rows[j][0] and longer - (counts[i] & counts[j]).total() > longer * (1 - least) + 1e-9:
                continue
            if longer and (rows[i][0] == rows[j][0] or distance(words[i].tolist(), words[j].tolist()) <= longer * (1 - least) + 1e-9):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: min(groups[find(i)]) for i in range(len(rows))}


def test_classes_equal_brute_force(spark, documents):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(random.choice(vocabulary) for _ in range(random.choice([8, 40, 120])))))
    for i in range(60, 110):
        words = random.choice(rows[:60])[1].split()
        for _ in range(int(len(words) * random.choice([0, 0.03, 0.06, 0.4]))):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[0][1] + f" tail{i}") for i in range(30)]
    docs = documents(rows).repartition(4)
    got = {r.doc_id: r.class_id for r in near_copies(docs).collect()}
    assert got == brute(rows)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c in got.values()})


def test_similarity_threshold():
    base = list(range(100))
    edits = lambda n: np.array([-1 if i < n else x for i, x in enumerate(base)])
    assert similar(np.array(base), edits(20)) and not similar(np.array(base), edits(21)) and not similar(np.array([]), np.array([]))


def test_edges(spark, documents, edge_texts):
    docs = documents(edge_texts)
    got = sorted([(r.doc_id, r.class_id) for r in near_copies(docs).collect()], key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7), (None, None), (None, None)], key=repr)
    assert drop_near_copies(docs).count() == len(edge_texts)
    assert near_copies(documents([])).count() == 0 == drop_near_copies(documents([])).count()


def test_crowded_sketch_values_lose_no_link(spark, documents):
    """Pairs that share a passage, and so their sketches, with many unrelated texts of about their
    length: neither is the shortest, nor the other's neighbour by length."""
    random.seed(4)
    word = lambda: f"w{random.randrange(10**6)}"
    passage = [word() for _ in range(30)]
    rows = [(1000, " ".join(passage))]
    for i in range(240):
        rows.append((i, " ".join(passage + [word() for _ in range(20 + i % 5)])))
    for i in range(0, 60, 3):
        words = rows[1 + i][1].split()
        words[32:41:2] = [word() for _ in range(5)]
        rows.append((500 + i, " ".join(words[:44] + [word()] + words[44:] + [word()])))
    got = {r.doc_id: r.class_id for r in near_copies(documents(rows).repartition(4)).collect()}
    assert got == brute(rows)


def test_crossing_equals_all_pairs():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, rng.integers(10, 60)).astype(np.uint64) for _ in range(60)]
    texts += [np.concatenate([t[: len(t) - 2], t[:1]]) for t in texts[:30]]
    words = Tokens(np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts])))
    n, label = np.array([len(t) for t in texts]), rng.integers(0, 50, len(texts))
    for side in (np.zeros(len(texts), np.int64), np.arange(len(texts)) // 60):
        got = {(min(a, b), max(a, b)) for some, b in crossing(n, label, side, bags(words), 0.8) for a in some.tolist()}
        true = {(i, j) for j in range(len(texts)) for i in range(j) if label[i] != label[j] and (side[i] != side[j] or not side.any()) and similar(texts[i], texts[j])}
        assert true and true <= got and len(got) < len(texts) * 20
        assert all(label[i] != label[j] and (side[i] != side[j] or not side.any()) for i, j in got)


def test_rows_are_dropped_by_their_own_text(spark, documents):
    x, y, z = ("alpha beta gamma delta epsilon", "one two three four five six", "seven eight nine ten")
    docs = documents([(3, x), (5, x), (5, y), (6, y), (6, z), (None, x), (9, None)])
    got = sorted((r.doc_id, r.class_id) for r in near_copies(docs).collect() if r.doc_id)
    assert got == [(3, 3), (5, 3), (5, 5), (6, 5), (6, 6), (9, 9)]
    kept = sorted(((r.doc_id, r.text) for r in drop_near_copies(docs).collect()), key=repr)
    assert kept == sorted([(3, x), (5, y), (6, z), (None, x), (9, None)], key=repr)


def test_other_similarity_and_clashing_names(spark, documents):
    base = [f"w{i}" for i in range(100)]
    docs = documents({1: " ".join(base), 2: " ".join(base[:70])}).selectExpr("doc_id", "text", "1 AS key", "2 AS row", "3 AS label", "4 AS class_id")
    assert {r.class_id for r in near_copies(docs, least=0.6).collect()} == {1} and {r.class_id for r in near_copies(docs).collect()} == {1, 2}
    kept = drop_near_copies(docs, least=0.6).collect()
    assert [r.asDict() for r in kept] == [{"doc_id": 1, "text": " ".join(base), "key": 1, "row": 2, "label": 3, "class_id": 4}]


def test_recall_at_the_border():
    """Pairs at a similarity of just 0.8, the edits spread at random, that agree in a sketch."""
    rng = np.random.default_rng(3)
    for n, least in ((10, 0.97), (20, 0.97), (35, 0.97), (60, 0.9), (200, 0.9), (600, 0.9)):
        found = 0
        for _ in range(150):
            words = rng.integers(0, 2**60, n).astype(np.uint64)
            edited = words.copy()
            edited[rng.permutation(n)[: n // 5]] = rng.integers(0, 2**60, n // 5)
            found += np.isin(sketch(words), sketch(edited)).any()
        assert found / 150 >= least, (n, found / 150)


def test_batches_do_not_change_classes(spark, documents):
    """Template pages: 120 common words and some of their own, dealt to several numbers of tasks."""
    random.seed(11)
    word = lambda: f"w{random.randrange(10**6)}"
    template = [word() for _ in range(120)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(60)]
        at = random.randrange(120)
        rows.append((2 * i, " ".join(template[:at] + own + template[at:])))
        words = rows[-1][1].split()
        for _ in range(random.choice([4, 12, 25])):
            words[random.randrange(len(words))] = word()
        rows.append((2 * i + 1, " ".join(words)))
    true = brute(rows)
    for parts in (1, 3, 9):
        got = {r.doc_id: r.class_id for r in near_copies(documents(rows).repartition(parts)).collect()}
        assert sum(got[k] == v for k, v in true.items()) >= 0.97 * len(true)
