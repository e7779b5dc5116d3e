"""Reading tables and keeping intermediate results where every executor can see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

FILE_ROWS = 200_000
#: Where the stored results that are in use lie.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back: later jobs start from the files,
    so a lost executor costs no recomputation of what lies before.

    rows: a bound of the rows, where it is known and they are short; they go to a file for each
    FILE_ROWS of them, not to one a partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/paperloom-{name}-{uuid.uuid4().hex}"
    with own_settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``stored``, in as many buckets by key as there are shuffle partitions: such tables join on the
    key without a shuffle. Rows are dealt out by the key first, so there is a file a bucket."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"paperloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    with own_settings(spark):
        df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the entry only: the files stay, and the frame reads them
    _places[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored results that nothing reads any more, and let the driver collect its
    garbage: Spark drops a step's broadcasts and shuffles when it sees that their frames are gone."""
    for df in frames:
        path = _places.pop(df)
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


@contextmanager
def own_settings(spark: SparkSession) -> Iterator[None]:
    """Settings while a step is written; the session's own come back after it.

    Rows go to Python a thousand at a time: ten thousand whole texts, Spark's default, are tens of
    megabytes on both sides. The step's shuffle files go when it is written, as nothing reads them
    again.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
