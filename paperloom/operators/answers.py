"""A store of model answers, addressed by what was asked.

The key of an answer is the digest of the backend's name, its token limit, the prompt and the text, so
a prompt is asked once over all rows, all runs and all documents that repeat it. Rows are reduced to
their different prompts, those with an answer are left out by an anti-join, the rest is asked and
appended, and the answers are joined back. Failures are kept beside the answers and asked again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .backends import Backend
from .models import MODEL_ANSWER, Ask, model_column

SCHEMA = "digest binary, answer string, error string, run string"


def digest_of(model: str, max_tokens: int, prompts: Column, contents: Column) -> Column:
    """SHA-256 of all that an answer depends on; null where the prompt is null. Each part goes with
    its length, so no two questions can run together."""
    part = lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)
    whole = F.concat(part(F.lit(model)), F.lit(f"{max_tokens};"), part(prompts), part(F.coalesce(contents, F.lit(""))))
    return F.unhex(F.sha2(whole.cast("binary"), 256))


class AnswerStore:
    """Answers in a folder that all executors see: a folder of Parquet files for each append.

    A folder counts once Spark has put its mark of success there, so an append that fails, or that
    an executor is lost in, leaves nothing that is read. Each reading names its folders: a plan that
    reads the store twice, before and after an append, reads two different inputs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folders(self) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(place):
            return []
        found = [x.getPath() for x in files.listStatus(place) if x.isDirectory()]
        success = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(str(x) for x in found if files.exists(success(x, "_SUCCESS")))

    def rows(self) -> DataFrame:
        """(digest, answer, error, run) of all that was ever asked."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders)

    def compact(self) -> None:
        """The answers of all appends in one folder; the others go. Frames read before are void."""
        before = self._folders()
        self._append(self.answers().withColumn("run", F.lit(uuid.uuid4().hex)))
        for folder in before:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)

    def answers(self) -> DataFrame:
        """(digest, answer, error), one row a digest: an answer before a failure."""
        best = F.max(F.struct(F.col("error").isNull().alias("good"), "run", "answer", "error")).alias("best")
        return self.rows().groupBy("digest").agg(best).select("digest", "best.answer", "best.error")

    def ask(self, rows: DataFrame, factory: Callable[[], Backend], prompts: Column, contents: Column, max_tokens: int, model: str) -> DataFrame:
        """Adds ``_model`` (answer, error) as ``model_column`` does, null where the prompt is null.

        What the store lacks is asked and appended before this returns; the result reads the store.
        Answers of equal questions are equal, also those of a backend that varies.
        """
        asked = rows.withColumn("_digest", digest_of(model, max_tokens, prompts, contents))
        new = asked.filter("_digest IS NOT NULL").select(F.col("_digest").alias("digest"), prompts.alias("prompt"), contents.alias("content"))
        new = new.join(self.rows().filter("error IS NULL").select("digest"), "digest", "left_anti")
        # equal questions are folded in the map side; what a group keeps is one of them
        new = new.groupBy("digest").agg(F.first("prompt").alias("prompt"), F.first("content").alias("content"))
        new = new.withColumn("_model", model_column(factory, F.col("prompt"), F.col("content"), max_tokens))
        self._append(new.select("digest", "_model.answer", "_model.error", F.lit(uuid.uuid4().hex).alias("run")))
        known = self.answers().select(F.col("digest").alias("_digest"), F.struct("answer", "error").cast(MODEL_ANSWER).alias("_model"))
        return asked.join(known, "_digest", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "_model")

    def _append(self, found: DataFrame) -> None:
        found.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def under(self, model: str) -> Ask:
        """The store as what the model operators ask, under a backend's name."""
        return lambda rows, factory, prompts, contents, max_tokens: self.ask(rows, factory, prompts, contents, max_tokens, model)
