import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm.quality_rules import IsolationForest, QualityModel, calibrated, fit_quality, keep_quality, quality_rules, statistics
from paperloom.llm.text import blocks


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated_lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(covered)]


def test_statistics_equal_brute_force(spark, sf):
    random.seed(3)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [None, "", " ", "\n", "a\n\na", "\na", "x y x y x y x"] + ["".join(random.choice("ab \n\t#é\x0b") for _ in range(random.randint(0, 120))) for _ in range(1500)]
    got = np.concatenate([statistics(b).counts for b in blocks(pa.array(texts), 5000)])
    assert got.tolist() == [brute(t) for t in texts]


def test_forest_finds_outliers():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(0, 0.1, (500, 3)), [[0.0, 2.0, 0.0]]])
    forest = IsolationForest(rows, subsample=256)
    scores = forest.scores(np.array([[0.0, 0.0, 0.0], [0.0, 2.5, 0.0], [0.0, 0.0, 1.0]]))
    assert scores[1] > scores[0] and scores[2] > scores[0]
    features = rng.normal(0, 0.05, (400, 8))
    good = np.arange(400) % 10 > 0
    features[~good, 2] += 1
    features[~good, 5] -= 1
    model = calibrated(features, good)
    rejected = model.forest.scores(features) > model.threshold
    assert rejected[~good].mean() > 0.9 and rejected[good].mean() < 0.02 and calibrated(features, np.ones(400, bool)).forest is None


def test_held_out_accuracy(spark):
    """Fitted on the smaller table's labels, judged on labelled rows of the larger one."""
    small, large = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
    read = lambda d, t: spark.read.parquet(f"{d}/{t}.parquet")
    model = fit_quality(read(large, "documents").filter("doc_id >= 2000"), read(large, "labels"))
    judged = quality_rules(read(large, "documents").filter("doc_id < 2000"), model).join(read(large, "labels"), "doc_id").filter("NOT base_failed").toPandas()
    good = judged[judged.quality == 1]
    poor = judged[judged.quality == 0]
    assert len(poor) > 20 and good.kept.mean() > 0.99 and 1 - poor.kept.mean() > 0.95
    assert fit_quality(read(small, "documents"), read(small, "labels"), sample=50) is not None


def test_edges(spark, documents, edge_texts):
    docs = documents(edge_texts)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_quality(docs, empty)
    assert model == QualityModel(None, 1.0)
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(docs.withColumn("score", F.lit(1)), model).collect()], key=repr)
    assert got == sorted([(i, *brute(t)) for i, t in edge_texts], key=repr)
    assert keep_quality(docs, model).count() == 0
    fine = documents({1: " ".join(f"w{i}" for i in range(60)), 2: " ".join(["a b c"] * 40)})
    kept = keep_quality(fine, model)
    assert kept.columns == fine.columns and [r.doc_id for r in kept.collect()] == [1]
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert fit_quality(fine, labels) == QualityModel(None, 1.0)
    assert quality_rules(documents([]), model).count() == 0
