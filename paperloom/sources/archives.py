"""A sink that writes very many small files into zip archives, and the source that reads them back.

On a disk a small file takes whole blocks, an entry of the file system and, in a folder of its own, another
of each; for texts of a few pages that is several times their bytes. An archive holds each file by its name
with exactly its bytes (deflated, with a checksum that is tested when it is read), and any tool unpacks it.

Rows (file, value) arrive sorted, and each file's values are written one after the other. A task attempt
writes archives of bounded size into a staging folder; the commit moves those of the attempts that Spark
accepted, one name for up to ARCHIVE_FILES files, and deletes the rest. So a failed task, a second attempt
and a failed job leave nothing behind. Any file system that Arrow reaches will do.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import READ_BYTES, checked_name, clear, file_system

FORMAT = "paperloom_archives"
ARCHIVE_FILES, ARCHIVE_BYTES = 20_000, 128 << 20  # an archive ends with the file that brings it to either
LEVEL = 1  # of deflation
_SCHEMA = pa.schema([("file", pa.string()), ("n_bytes", pa.int64()), ("content", pa.binary())])


def _member(name: str | None) -> str:
    """A name as an archive holds it; ValueError if that would be another one."""
    if checked_name(name) != name or "\0" in name:
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Archives(WriterCommitMessage):
    """The archives of an attempt."""

    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, most_files: int, most_bytes: int):
        self.path, self.most_files, self.most_bytes = path, most_files, most_bytes
        self.staging = posixpath.join(path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Archives:
        system, root = file_system(self.staging)
        attempt = TaskContext.get().taskAttemptId()
        names, out, archive, held = [], None, None, 0
        try:
            for file, rows in groupby(iterator, key=lambda row: row[0]):
                if archive is None:
                    system.create_dir(root, recursive=True)
                    names.append(f"{attempt}-{len(names)}.zip")
                    out = system.open_output_stream(posixpath.join(root, names[-1]), buffer_size=1 << 20)
                    archive, held = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL), 0
                with archive.open(_member(file), "w", force_zip64=True) as member:
                    for _, value in rows:
                        held += member.write((value or "").encode())
                if len(archive.filelist) >= self.most_files or held >= self.most_bytes:
                    archive.close()
                    out.close()
                    out = archive = None
        finally:
            for stream in (archive, out):
                if stream:
                    stream.close()
        return Archives(names)

    def commit(self, messages: list[Archives | None]) -> None:
        (system, source), (_, target) = file_system(self.staging), file_system(self.path)
        for name in [name for m in messages if m for name in m.names]:
            system.move(posixpath.join(source, name), posixpath.join(target, name))
        clear(self.staging)

    def abort(self, messages: list[Archives | None]) -> None:
        clear(self.staging)


@dataclass
class Archive(InputPartition):
    name: str | None


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = _archives(self.path)
        return [Archive(name) for name in found] or [Archive(None)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        system, root = file_system(self.path)
        rows, held = [], 0
        with system.open_input_file(posixpath.join(root, partition.name)) as f, zipfile.ZipFile(io.BufferedReader(f, 1 << 20)) as archive:
            for member in archive.filelist:
                content = archive.read(member)
                rows.append((member.filename, len(content), content))
                held += len(content)
                if held >= READ_BYTES or len(rows) >= 10_000:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _archives(path: str) -> list[str]:
    system, root = file_system(path)
    found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".zip"))


class ZipFiles(DataSource):
    """``rows.write.format("paperloom_archives").save(path)`` for sorted rows (file, value), and
    ``spark.read.format("paperloom_archives").load(path)``; options files and bytes bound an archive."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, n_bytes long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["file", "value"]:
            raise ValueError("rows must be (file, value)")
        return _Writer(self.options["path"], int(self.options.get("files", ARCHIVE_FILES)), int(self.options.get("bytes", ARCHIVE_BYTES)))


def write_archives(rows: DataFrame, path: str, order: tuple[str, ...] = ("pos",), dealt: bool = False, files: int = ARCHIVE_FILES, size: int = ARCHIVE_BYTES) -> None:
    """Write rows (file, *order, value) into archives below path, a folder that holds none yet: a file
    holds its values one after the other, in order. The rows of a file are sorted by Spark and streamed.

    dealt: the rows of each file are in one partition already, so they are not shuffled.
    """
    if _archives(path):
        raise ValueError(f"{path} holds archives already")
    rows.sparkSession.dataSource.register(ZipFiles)
    parts = rows if dealt else rows.repartition("file")
    ordered = parts.sortWithinPartitions("file", *order).select("file", "value")
    ordered.write.format(FORMAT).option("files", str(files)).option("bytes", str(size)).mode("append").save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes, content) of the files in the archives below path, an archive a task."""
    spark.dataSource.register(ZipFiles)
    return spark.read.format(FORMAT).load(path)
