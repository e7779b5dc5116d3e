"""Embedding backends by name: functions from a batch of texts to vectors.

A backend is either a column expression, which stays in the JVM (``hash``), or a model: a factory whose
result maps a list of texts to an array. A model is made once a process and kept there for later
tasks. It gets Arrow batches, with texts of like length next to each other, so that padding a batch to
its longest text wastes little; rows come back in their own order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

Model = Callable[[Sequence[str]], np.ndarray]


@dataclass(frozen=True)
class Embedder:
    """name and width of the vectors; ``expression`` of a text column, or ``factory`` of a model with
    the number of texts that it is given at a time."""

    name: str
    width: int
    expression: Callable[[Column, int], Column] | None = None
    factory: Callable[[], Model] | None = None
    batch: int = 64


_registered: dict[str, Embedder] = {}
_loaded: dict[str, Model] = {}


def register(embedder: Embedder) -> Embedder:
    _registered[embedder.name] = embedder
    return embedder


def resolve(name: str, strict: bool = False, fallback: str = "hash") -> Embedder:
    """The backend of a name; if not strict, the fallback where there is none."""
    for candidate in [name] if strict else [name, fallback]:
        if candidate in _registered:
            return _registered[candidate]
    raise LookupError(f"no embedder {name!r}")


def _model(embedder: Embedder) -> Model:
    if embedder.name not in _loaded:
        _loaded[embedder.name] = embedder.factory()
    return _loaded[embedder.name]


def vectors_of(model: Model, texts: Sequence[str | None], width: int, batch: int) -> np.ndarray:
    """(texts x width) floats, in the order of the texts; null counts as empty."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), width), np.float32)
    order = np.argsort([len(t) for t in texts], kind="stable")
    for lo in range(0, len(order), batch):
        at = order[lo : lo + batch]
        found = np.asarray(model([texts[i] for i in at]), np.float32)
        if found.shape != (len(at), width):
            raise ValueError(f"an embedder of width {width} gave {found.shape} for {len(at)} texts")
        out[at] = found
    return out


def embedded(rows: DataFrame, embedder: Embedder, text_col: str = "content", out_col: str = "content_embedding") -> DataFrame:
    """Adds the vectors of a text column, as an array of floats."""
    kept = rows.drop(out_col)
    if embedder.expression:
        return kept.withColumn(out_col, embedder.expression(kept[f"`{text_col}`"], embedder.width))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or _model(embedder)
            found = vectors_of(model, batch.column(at).to_pylist(), embedder.width, embedder.batch)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * embedder.width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], [*batch.schema.names, "vector"])

    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])  # names that need no quoting
    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
    return out.toDF(*kept.columns, out_col)


def letter_counts() -> Model:
    """A model without weights: how often a text has each of the letters a to z, in either case."""

    def model(texts: Sequence[str]) -> np.ndarray:
        counts = np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=128)[:128] for t in texts])
        return counts[:, 97:123] + counts[:, 65:91]

    return model


register(Embedder("letters", 26, factory=letter_counts))
