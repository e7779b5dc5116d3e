"""Back matter removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACK_MATTER
from ..functions.text import bound, marker_pattern


def truncate_back_matter(rows: DataFrame, markers: tuple[str, ...] = BACK_MATTER) -> DataFrame:
    """Rows (doc_id, pos, content) up to each document's first with a marker, which is cut from the
    marker on and stays even if that leaves nothing. A document without a marker keeps all."""
    pattern = marker_pattern(markers)
    first = F.min(F.when(F.col("content").rlike(pattern), F.col("pos"))).over(Window.partitionBy("doc_id"))
    kept = rows.withColumn("_first", first).filter("_first IS NULL OR pos <= _first")
    cut = F.regexp_replace("content", rf"{pattern}[\s\S]*", "")
    return kept.withColumn("content", F.when(F.col("pos") == F.col("_first"), cut).otherwise(F.col("content"))).drop("_first")


def truncated(paragraphs: Column, markers: tuple[str, ...] = BACK_MATTER) -> Column:
    """The same on an array of a document's paragraphs, before it is exploded: no shuffle."""
    pattern = marker_pattern(markers)

    def cut(rows: Column, first: Column) -> Column:
        last = F.regexp_replace(F.get(rows, first - 1), rf"{pattern}[\s\S]*", "")
        return F.when(first > 0, F.concat(F.slice(rows, F.lit(1), first - 1), F.array(last))).otherwise(rows)

    def at(rows: Column) -> Column:
        return F.array_position(F.transform(rows, lambda p: p.rlike(pattern)), F.lit(True)).cast("int")

    return bound(paragraphs, lambda rows: bound(at(rows), lambda first: cut(rows, first)))
