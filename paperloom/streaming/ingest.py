"""New documents as a stream.

Paragraph ranking and back matter need a whole document, so a document is one row of the stream and
every stage up to the summaries works inside a micro-batch. What outlives a batch is which version of
a document was done: keyed state holds its digest, so a document that comes again unchanged is passed
over, also after a restart, and a changed one is done anew. State that is not met for a while expires.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import base_name
from ..plans.pipeline import Pipeline


def read_text_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id, text, modified) of each new file under path and the folders in it; modified is the
    file's time in microseconds."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    modified = F.unix_micros(F.col("_metadata.file_modification_time")).alias("modified")
    return rows.select(base_name(F.col("_metadata.file_path")).alias("doc_id"), modified, F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"))


class Versions(StatefulProcessor):
    """Passes on the documents whose digest is not that of the version done last. The state of a
    document is its digest and the number of its versions so far."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version int", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None  # of the versions of one batch the latest counts, of equally late ones the last by text
        for part in rows:
            for row in part.itertuples(index=False):
                at = (row.modified, row.text)
                if newest is None or at > newest[0]:
                    newest = at, row
        known = self.last.get() if self.last.exists() else (None, 0)
        row = newest[1]
        if row.digest != known[0]:
            self.last.update((row.digest, known[1] + 1))
            yield pd.DataFrame({"doc_id": [key[0]], "text": [row.text], "digest": [row.digest], "version": [known[1] + 1]})
        elif self.expire_ms is not None:
            self.last.update(known)  # met again: the time starts anew

    def close(self) -> None:
        pass


def changed_documents(docs: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """(doc_id, text, digest, version) of the documents of a stream that are new or changed. docs may
    have ``modified`` (long); the latest of several versions in one batch counts. Null ids and null
    texts are passed over. Needs the RocksDB state store.

    With ``expire_ms`` a state goes that long after its document was last met. Spark then has to look
    at the clock in every batch, so such a query needs a processing-time trigger: with availableNow it
    would never run out of batches.
    """
    rows = docs if "modified" in docs.columns else docs.withColumn("modified", F.lit(0).cast("long"))
    rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.sha2("text", 256).alias("digest"), "modified")
    return rows.groupBy("doc_id").transformWithStateInPandas(
        Versions(expire_ms), "doc_id string, text string, digest string, version int", "Update", "ProcessingTime" if expire_ms is not None else "None"
    )


def latest(spark: SparkSession, output: str) -> DataFrame:
    """The rows of ``run_stream`` under output, of each document only those of its last version."""
    rows, done = spark.read.parquet(output), spark.read.parquet(f"{output}-documents")
    newest = done.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["doc_id", "batch"], "left_semi").drop("batch")


def run_stream(docs: DataFrame, pipeline: Pipeline, output: str, checkpoint: str, mode: str = "comprehensive", stage: str | None = None, write: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Process each micro-batch and append a stage's rows (by default the last) as Parquet.

    A batch is written to a folder of its number and overwritten if it is tried again, so a
    restart after a failure leaves no row twice. Which documents a batch had is written beside, so that
    ``latest`` gives what one run over the last version of every document would.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        stages = pipeline.process(rows, mode)
        out = stages[stage or list(stages)[-1]]
        (write or (lambda df, n: df.write.mode("overwrite").parquet(f"{output}/batch={n}")))(out, number)
        rows.select("doc_id").write.mode("overwrite").parquet(f"{output}-documents/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
