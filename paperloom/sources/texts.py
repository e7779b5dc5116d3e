"""A source of whole text files, as a Python data source.

Files are listed with their sizes and packed into partitions of about PARTITION_BYTES, so a folder of
very many small files makes few tasks and no task gets many large ones. A document is named by its path
below the root without the last extension, so equal names in two folders stay two documents. Bytes that
are no UTF-8 are dropped, and nothing else is: a replacement character that a file holds stays.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_system

FORMAT = "paperloom_texts"
PARTITION_BYTES, FILE_COST = 64 << 20, 256 << 10  # a file counts for its size and the cost to open it
BATCH_BYTES = 16 << 20
_SCHEMA = pa.schema([("doc_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("text", pa.string())])


@dataclass
class Files(InputPartition):
    names: list[str]


def packed(files: list[tuple[str, int]], target: int = PARTITION_BYTES, cost: int = FILE_COST) -> list[list[str]]:
    """Names of (name, size) in parts of about ``target`` bytes: large files first, each to the part
    that has least so far. A file is never split."""
    import heapq

    total = sum(size + cost for _, size in files)
    parts = [(0, i, []) for i in range(max(1, min(len(files), -(-total // target))))]
    for name, size in sorted(files, key=lambda f: (-f[1], f[0])):
        filled, i, names = heapq.heappop(parts)
        names.append(name)
        heapq.heappush(parts, (filled + size + cost, i, names))
    return [sorted(names) for _, _, names in sorted(parts, key=lambda p: p[1]) if names]


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, target: int):
        self.path, self.suffix, self.target = path, suffix, target

    def partitions(self) -> list[InputPartition]:
        system, root = file_system(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        skipped = lambda name: any(part.startswith(("_", ".")) for part in name.split("/"))
        files = [(posixpath.relpath(f.path, root), f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(self.suffix)]
        return [Files(names) for names in packed([f for f in files if not skipped(f[0])], self.target)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = file_system(self.path)
        rows, held = [], 0
        for name in partition.names:
            with system.open_input_stream(posixpath.join(root, name)) as f:
                raw = f.read()
            rows.append((posixpath.splitext(name)[0], name, len(raw), raw.decode("utf-8", errors="ignore")))
            held += len(raw)
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


class TextFiles(DataSource):
    """``spark.read.format("paperloom_texts").load(path)``; options suffix and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id string, path string, size long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".txt"), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(doc_id, path, size, text) of the files below path that end in ``suffix``; hidden files, and those
    in hidden folders, are passed over."""
    spark.dataSource.register(TextFiles)
    return spark.read.format(FORMAT).option("suffix", suffix).option("partitionBytes", str(partition_bytes)).load(path)
