"""Sinks. Parquet carries rows between stages; the text forms are for readers outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank, or_empty

#: What a stage makes of a file name, by (pattern, replacement).
STAGE_NAMES = {
    "processed": (r"([^/]*)$", "Processed_$1"),
    "embedded": (r"(?:Processed_)?([^/]*)$", "Embedding_$1"),
    "filtered": (r"\.txt", "_Filtered.txt"),
    "abstract": (r"\.txt", "_Abstract.txt"),
    "summarized": (r"\.txt", "_Summarized.txt"),
    "overall": (r"\.txt", "_Overall.txt"),
}


def output_name(path: Column, stage: str) -> Column:
    """The stage's file name for an input's; the last four change every ``.txt`` in the path."""
    pattern, by = STAGE_NAMES[stage]
    if stage in ("processed", "embedded"):
        folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"[^/]*$", 0)
        return F.concat(folder, F.regexp_replace(name, f"^{pattern}", by))
    return F.regexp_replace(path, pattern, by)


def document_texts(rows: DataFrame, column: str = "content", keys: tuple[str, ...] = ("doc_id",), order: str = "pos") -> DataFrame:
    """(keys, text): every row's text with a blank line after it, in order."""
    value = F.struct(F.col(order), F.concat(or_empty(F.col(column)), F.lit("\n\n")).alias("value"))
    texts = F.transform(F.array_sort(F.collect_list(value)), lambda r: r["value"])
    return rows.groupBy(*keys).agg(F.array_join(texts, "").alias("text"))


def write_text(rows: DataFrame, path: str, column: str = "content", keys: tuple[str, ...] = ("doc_id",)) -> None:
    """One text file a key, in a folder of its name; keys without rows make none. The writer ends
    a value with a line break, so the text goes without its last one."""
    texts = document_texts(rows, column, keys).withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    texts.repartition(*keys).write.mode("overwrite").partitionBy(*keys).text(path)


def write_sections(rows: DataFrame, path: str) -> None:
    """A file for each document and section that has a paragraph."""
    write_text(rows.filter(not_blank(F.col("content"))), path, keys=("doc_id", "section"))


def write_json(rows: DataFrame, path: str, column: str = "overall") -> None:
    """Each document's raw JSON; Spark's text writer ends it with a line break."""
    rows.select("doc_id", F.col(column).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated, with a header."""
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def remaining(inputs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Inputs that have no completed work yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
