"""A sink that writes files with exactly the bytes they are given, by names of their own.

Spark's text writer names its files itself and ends every row with a line break. This one is a Python
data source: rows (file, value) arrive sorted, and each file's values are written one after the other.
A task attempt writes into a staging folder of its own, by numbers, so that a document's folder is made
once, at its place; beside it is a list of its files. The commit accepts the lists of the attempts that
Spark accepted, a list a task, and a second job moves the listed files to their places. So a failed task,
a second attempt and a failed job leave nothing behind, and no name of a file passes through the driver.
Any file system that Arrow reaches will do.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..config import PRIORITY
from ..functions.text import not_blank, or_empty

FORMAT = "paperloom_files"
MOVERS = 8  # files that a task moves at a time
READ_BYTES = 16 << 20  # of files that a task has read and not passed on


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def checked_name(name: str | None) -> str:
    """A file's name below the root; ValueError if it is empty or leads out of it."""
    clean = posixpath.normpath(name or "")
    if not name or clean.startswith(("/", "..")) or clean in (".", ""):
        raise ValueError(f"not a file name: {name!r}")
    return clean


@dataclass
class Written(WriterCommitMessage):
    """Where the list of an attempt's files lies, if it wrote any."""

    listed: str | None


class _Writer(DataSourceWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.staging)
        attempt = str(TaskContext.get().taskAttemptId())
        folder, listed = posixpath.join(root, attempt), posixpath.join(root, "listed", f"{attempt}.json")
        names, out, last, n = None, None, None, 0
        try:
            for file, value in iterator:
                if file != last:
                    if out:
                        out.close()
                    out, last = None, file
                    name = checked_name(file)
                    if names is None:
                        system.create_dir(posixpath.dirname(listed), recursive=True)
                        names = system.open_output_stream(listed, buffer_size=1 << 16)
                        system.create_dir(folder, recursive=True)
                    names.write((json.dumps({"attempt": attempt, "number": n, "file": name}) + "\n").encode())
                    out, n = system.open_output_stream(posixpath.join(folder, str(n))), n + 1
                out.write((value or "").encode())
        finally:
            for stream in (out, names):
                if stream:
                    stream.close()
        return Written(listed if names else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.staging)
        accepted = posixpath.join(root, "accepted")
        lists = [m.listed for m in messages if m and m.listed]
        if lists:
            system.create_dir(accepted, recursive=True)
        for listed in lists:
            system.move(listed, posixpath.join(accepted, posixpath.basename(listed)))

    def abort(self, messages: list[Written | None]) -> None:
        clear(self.staging)


class FileSink(DataSource):
    """Stages rows (file, value); ``write_files`` moves the files to their places."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["file", "value"]:
            raise ValueError("rows must be (file, value)")
        return _Writer(self.options["path"])


def clear(folder: str) -> None:
    system, root = file_system(folder)
    if system.get_file_info(root).type != pafs.FileType.NotFound:
        system.delete_dir(root)


def _moved(accepted: DataFrame, staging: str, path: str) -> DataFrame:
    """(file) of the accepted files (attempt, number, file), each moved to its place by the task that has
    it. A task that runs again passes over what is moved already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, source), (_, target) = file_system(staging), file_system(path)

        def move(attempt: str, number: int, name: str) -> None:
            old, new = posixpath.join(source, attempt, str(number)), posixpath.join(target, name)
            system.create_dir(posixpath.dirname(new), recursive=True)
            try:
                system.move(old, new)
            except OSError:
                if [x.type for x in system.get_file_info([old, new])] != [pafs.FileType.NotFound, pafs.FileType.File]:
                    raise

        with ThreadPoolExecutor(MOVERS) as movers:
            for batch in batches:
                for _ in movers.map(move, *(column.to_pylist() for column in batch.columns)):
                    pass
                yield batch.select(["file"])

    return accepted.select("attempt", "number", "file").mapInArrow(run, "file string")


def _removed(attempts: DataFrame, staging: str) -> None:
    """Delete the folders of the attempts, which hold no files any more, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for attempt in batch.column(0).to_pylist():
                clear(posixpath.join(staging, attempt))
            yield batch

    attempts.mapInArrow(run, attempts.schema).write.format("noop").mode("overwrite").save()


def write_files(rows: DataFrame, path: str, order: tuple[str, ...] = ("pos",), listing: str | None = None) -> None:
    """Write rows (file, *order, value): a file holds its values one after the other, in order. The
    rows of a file are sorted by Spark and streamed; files that are there are replaced.

    listing: a folder for the names of the files as rows (file), for ``read_files``.
    """
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    staging = posixpath.join(path, f"_staging-{uuid.uuid4().hex}")
    dealt = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "value")
    try:
        dealt.write.format(FORMAT).mode("append").save(staging)
        system, root = file_system(staging)
        lists = posixpath.join(staging, "accepted")
        some = system.get_file_info(posixpath.join(root, "accepted")).type != pafs.FileType.NotFound
        schema = "attempt string, number long, file string"
        accepted = spark.read.schema(schema).json(lists) if some else spark.createDataFrame([], schema)
        moved = _moved(accepted.repartition("file"), staging, path)
        if listing:
            moved.write.mode("append").parquet(listing)
        elif some:
            moved.write.format("noop").mode("overwrite").save()
        if some:
            _removed(accepted.select("attempt").distinct(), staging)
    finally:
        clear(staging)


def read_files(names: DataFrame, path: str) -> DataFrame:
    """(file, n_bytes, content) of the files below path that the rows (file) name, each read by the
    task that has its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)

        def batch_of(files: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array([len(c) for c in contents], pa.int64()), pa.array(contents, pa.binary())], ["file", "n_bytes", "content"])

        files, contents, held = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(posixpath.join(root, checked_name(name))) as f:
                    contents.append(f.read())
                files.append(name)
                held += len(contents[-1])
                if held >= READ_BYTES or len(files) >= 10_000:
                    yield batch_of(files, contents)
                    files, contents, held = [], [], 0
        if files:
            yield batch_of(files, contents)

    return names.select("file").mapInArrow(run, "file string, n_bytes long, content binary")


def _paragraph(column: str) -> Column:
    return F.concat(or_empty(F.col(column)), F.lit("\n\n"))


def _name(doc: Column, suffix: Column | str) -> Column:
    """``<document>/<document><suffix>``: a folder for each document."""
    doc = doc.cast("string")
    return F.concat(doc, F.lit("/"), doc, F.lit(suffix) if isinstance(suffix, str) else suffix)


def text_files(rows: DataFrame, column: str = "content", suffix: str = ".txt", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Each document's texts, a blank line after each, as rows for ``write_files``."""
    return rows.select(_name(F.col("doc_id"), suffix).alias("file"), *order, _paragraph(column).alias("value"))


def section_files(rows: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """A file for each section that has a paragraph."""
    kept = rows.filter(not_blank(F.col("content")))
    return kept.select(_name(F.col("doc_id"), F.concat(F.lit("_"), F.col("section"), F.lit(".txt"))).alias("file"), *order, _paragraph("content").alias("value"))


def priority_files(rows: DataFrame, priority: tuple[str, ...] = PRIORITY, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """One file with the paragraphs of the priority sections, section by section; none without any.
    The order of its rows is (part, *order)."""
    part = F.coalesce(*[F.when(F.col("section") == name, i) for i, name in enumerate(priority)])
    kept = rows.withColumn("part", part).filter("part IS NOT NULL").filter(not_blank(F.col("content")))
    return kept.select(_name(F.col("doc_id"), "_priority.txt").alias("file"), "part", *order, _paragraph("content").alias("value"))


def output_files(rows: DataFrame, order: tuple[str, ...] = ("part", "page_no", "pos")) -> DataFrame:
    """A file for each named output of ``process_pages`` that has a paragraph."""
    kept = rows.filter(not_blank(F.col("content")))
    return kept.select(_name(F.col("doc_id"), F.concat(F.lit("_"), F.col("name"), F.lit(".txt"))).alias("file"), *order, _paragraph("content").alias("value"))


def json_files(rows: DataFrame, column: str = "overall") -> DataFrame:
    """Each document's JSON, nothing before or behind it. order: none is needed."""
    return rows.select(_name(F.col("doc_id"), "_Overall.txt").alias("file"), F.lit(0).alias("pos"), or_empty(F.col(column)).alias("value"))
