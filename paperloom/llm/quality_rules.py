"""Quality rules: exact rule statistics, judged by an isolation forest.

One forest over all statistics is grown on a bounded sample of labelled documents: path lengths
over random splits tell how easily a document is set apart. A split's attribute is drawn with a
chance in proportion to its range in the node (all are shares, so ranges compare): with equal
chances most splits go to statistics in which nothing stands out. Held-out labelled rows choose
the subsample size and calibrate the threshold. Statistics, scores and verdicts cover every
document and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Block, Fingerprints, blocks, mix, per_document, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS = 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "dup_lines", "repeats", "word_length", "digits", "upper", "marks", "distinct"]


class Statistics(NamedTuple):
    counts: np.ndarray  # documents x COUNTS
    features: np.ndarray  # documents x FEATURES


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, whether it occurs more than once, and whether this is its first place."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    leads = np.zeros(len(keys), bool)
    leads[first] = True
    return counts[inverse] > 1, leads


def statistics(block: Block) -> Statistics:
    """Rule statistics of the documents of a block.

    Equality of lines and of word windows is that of 64-bit fingerprints within one document.
    """
    n, data = block.hi - block.lo, block.data
    found, prints = words(block), Fingerprints(data)
    n_words = np.diff(found.first)
    doc = np.repeat(np.arange(n), n_words)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points so far
    chars = lead[found.end] - lead[found.start]
    word_chars = np.bincount(doc, chars, minlength=n).astype(np.int64)
    n_symbols = per_document(block, np.flatnonzero(SYMBOLS[data]))

    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    hashes = prints.spans(found.start, found.end) if len(found.start) else np.zeros(0, np.uint64)
    own = mix(hashes ^ salt[doc])
    covered = np.zeros(len(doc), bool)
    if len(doc) > 2:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        twice, _ = _repeats(mix(own[inside] * np.uint64(3) + mix(own[inside + 1] * np.uint64(5) + mix(own[inside + 2]))))
        for shift in range(3):
            covered[inside[twice] + shift] = True
    n_repeat = np.bincount(doc[covered], minlength=n)
    distinct = np.bincount(doc[_repeats(own)[1]], minlength=n) if len(doc) else np.zeros(n)

    cuts = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([block.offsets[:-1], cuts + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(cuts[np.minimum(np.searchsorted(cuts, starts), len(cuts) - 1)] if len(cuts) else len(data), len(data))
    limit = block.offsets[np.searchsorted(block.offsets, starts, "right")]
    ends = np.where(ends < starts, limit, np.minimum(ends, limit))
    has_word = np.searchsorted(found.start, ends) > np.searchsorted(found.start, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_doc = np.searchsorted(block.offsets, starts, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    if len(starts):
        _, leads = _repeats(mix(prints.spans(starts, ends) ^ salt[line_doc]))
        n_dup = np.bincount(line_doc[~leads], minlength=n)
    else:
        n_dup = np.zeros(n, np.int64)

    digits = per_document(block, np.flatnonzero((data >= 48) & (data < 58)))
    upper = per_document(block, np.flatnonzero((data >= 65) & (data < 91)))
    marks = per_document(block, np.flatnonzero(((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))))
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.column_stack([np.sqrt(np.minimum(n_symbols / w, 1)), n_dup / np.maximum(n_lines, 1), n_repeat / w, word_chars / w / 10, digits / c, upper / c, marks / c, distinct / w])
    return Statistics(np.column_stack([n_words, word_chars, n_symbols, n_dup, n_repeat]).astype(np.int64), features)


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Under 50 words, or over half of the words in repeated three-word windows."""
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


def _expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random splits of random attributes, in heap order; a leaf above the last level sends rows on
    to the left."""

    def __init__(self, rows: np.ndarray, trees: int = 200, subsample: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.attribute = np.zeros((trees, inner), np.int64)
        self.split = np.full((trees, inner), np.inf)
        self.path = np.zeros((trees, leaves))
        self.unit = float(_expected_path(size)) or 1.0
        for tree in range(trees):
            self._grow(tree, 0, 0, rows[rng.permutation(len(rows))[:size]], rng)

    def _grow(self, tree: int, node: int, level: int, rows: np.ndarray, rng: np.random.Generator) -> None:
        spans = np.ptp(rows, axis=0) if len(rows) else np.zeros(rows.shape[1])
        if level == self.depth or not spans.any():
            last = node
            for _ in range(level, self.depth):
                last = 2 * last + 1
            self.path[tree, last - (2**self.depth - 1)] = level + float(_expected_path(len(rows)))
            return
        attribute = int(rng.choice(len(spans), p=spans / spans.sum()))
        values = rows[:, attribute]
        split = rng.uniform(values.min(), values.max())
        split = split if split > values.min() else values.max()
        self.attribute[tree, node], self.split[tree, node] = attribute, split
        self._grow(tree, 2 * node + 1, level + 1, rows[values < split], rng)
        self._grow(tree, 2 * node + 2, level + 1, rows[values >= split], rng)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in 0..1, higher for rows that random splits set apart sooner."""
        tree, row = np.arange(len(self.split))[None, :], np.arange(len(rows))[:, None]
        node = np.zeros((len(rows), len(self.split)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[row, self.attribute[tree, node]] >= self.split[tree, node])
        return 2 ** (-self.path[tree, node - (2**self.depth - 1)].mean(1) / self.unit)


class QualityModel(NamedTuple):
    """A row is rejected if its anomaly score is above the threshold; without a forest none is."""

    forest: IsolationForest | None
    threshold: float

    def scores(self, stats: Statistics) -> np.ndarray:
        """The ratio of score to threshold; over 1 is rejected, 0 without a forest."""
        return np.zeros(len(stats.counts)) if self.forest is None else self.forest.scores(stats.features) / self.threshold


def calibrated(features: np.ndarray, good: np.ndarray, keep_good: float = 0.998, gain: float = 0.05, trees: int = 200, subsamples: tuple[int, ...] = (32, 64, 128)) -> QualityModel:
    """Grow on every other labelled row (of poor ones at most one to ten good ones, so that they stay
    anomalies), calibrate on the others.

    Of the forests, one a subsample size, that which parts the held-out rows best stays, and of equal
    ones that with the widest gap. The threshold is the midpoint after the least score that rejects
    at most 1 - keep_good of the good rows and parts best. Without good or poor rows, or if it
    rejects under ``gain`` of the poor ones, there is no forest.
    """
    fine, poor = np.flatnonzero(good), np.flatnonzero(~good)
    fit = np.concatenate([fine[::2], poor[::2][: max(1, len(fine) // 20)]])
    fine, poor = fine[1::2], poor[1::2]
    best = (0.0, 0.0, None, 1.0)
    if len(fine) and len(poor):
        for subsample in subsamples:
            forest = IsolationForest(features[fit], trees, subsample)
            kept, caught = np.sort(forest.scores(features[fine])), np.sort(forest.scores(features[poor]))
            floor = kept[max(0, int(np.ceil(keep_good * len(kept))) - 1)]
            tried = np.unique(np.concatenate([[floor], kept[kept >= floor], caught[caught >= floor]]))
            lost = 1 - np.searchsorted(kept, tried, "right") / len(kept)
            won = 1 - np.searchsorted(caught, tried, "right") / len(caught)
            at = int(np.argmax(won - lost))
            above = tried[at + 1] if at + 1 < len(tried) else tried[at]
            found = (float(won[at] - lost[at]), float(above - tried[at]), forest, float(tried[at] + above) / 2)
            if won[at] >= gain and found[:2] > best[:2]:
                best = found
    return QualityModel(*best[2:])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000, keep_good: float = 0.998, trees: int = 200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``sample`` labelled documents: those first by a hash of their id.

    A document labelled more than once counts as good only if all its labels are 1; null ids and
    labels are left out, as are documents that fail the base rules (they need no forest). The
    driver receives ``sample`` rows of eight numbers, and the ids are broadcast (as many).
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna()
        .groupBy("id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                stats = statistics(block)
                sound = np.flatnonzero(~base_failed(stats.counts))
                part = batch.slice(block.lo, block.hi - block.lo).take(pa.array(sound))
                yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("label").cast(pa.int64()), *[pa.array(c) for c in stats.features[sound].T]], ["id", "label", *FEATURES])

    schema = "id string, label long, " + ", ".join(f"{f} double" for f in FEATURES)
    found = rows.mapInArrow(measured, schema).toPandas().sort_values(["id", *FEATURES], kind="stable")
    order = np.random.default_rng(11).permutation(len(found))
    return calibrated(found[FEATURES].to_numpy(float)[order], found["label"].to_numpy()[order] > 0, keep_good, trees=trees)


def quality_rules(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id, the five counts, base_failed, score (double) and kept of every row.

    Rows stay where they are read (no shuffle). Null text has no words, so it fails the base
    rules, as does an empty one. A very long text is measured whole (a task takes some fifty times
    its size for its words and lines). A null id stays null. Repeated rows are judged one by one, alike; an empty table gives
    an empty result; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                stats = statistics(block)
                failed, scores = base_failed(stats.counts), shared.value.scores(stats)
                ids = batch.column(0).slice(block.lo, block.hi - block.lo)
                kept = ~failed & (scores <= 1)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in stats.counts.T], pa.array(failed), pa.array(scores), pa.array(kept)], ["id", *COUNTS, "base_failed", "score", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(judged, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "kept", F.round("score", 9).alias("score"))


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that quality_rules keeps: null, empty and very long texts,
    repeated rows and an empty table as there. Other columns, whatever their names, go along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(at)):
                stats = statistics(block)
                kept = ~base_failed(stats.counts) & (shared.value.scores(stats) <= 1)
                yield batch.slice(block.lo, block.hi - block.lo).filter(pa.array(kept))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that need no quoting
    return plain.mapInArrow(sifted, plain.schema).toDF(*docs.columns)
