"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spm import MergeCounter, PieceModel


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", cache: int = 400_000) -> DataFrame:
    """Return id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    The model is read once on the driver and broadcast (about half a megabyte). A row never
    leaves its partition: there is no shuffle, and memory is one Arrow batch plus a unit cache
    of at most ``cache`` entries.

    Null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows are
    counted one by one; an empty table gives an empty result; other columns are left out, so
    their names cannot clash.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def measured(batches):
        counter = MergeCounter(PieceModel(raw.value), cache)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len((t or "").encode()) for t in texts]
            tokens = [counter.count(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(measured, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
