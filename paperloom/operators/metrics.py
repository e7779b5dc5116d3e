"""Stage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, kilobytes, megabytes, not_blank, or_empty, percent, segments


def row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))


def segmentation_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_blank, n_paragraphs, mean_chars), all on the document's own row; the mean is
    null without paragraphs."""
    lines = F.split(F.regexp_replace(or_empty(F.col(text_col)), r"\r\n?", "\n"), "\n")
    of_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, lambda line: ~not_blank(line))).alias("blank")))
    sizes = F.transform(segments(F.col(text_col)), F.char_length)
    mean = bound(sizes, lambda x: F.struct(F.size(x).alias("n"), F.try_divide(F.aggregate(x, F.lit(0).cast("long"), lambda s, n: s + n).cast("double"), F.size(x).cast("double")).alias("mean")))
    rows = docs.select("doc_id", of_lines.alias("lines"), mean.alias("parts"))
    return rows.select("doc_id", F.col("lines.n").alias("n_lines"), F.col("lines.blank").alias("n_blank"), F.col("parts.n").cast("long").alias("n_paragraphs"), F.round("parts.mean", 6).alias("mean_chars"))


def stage_metrics(documents: DataFrame, stages: dict[str, DataFrame], column: str = "content") -> DataFrame:
    """One row a document: lines and bytes of each stage, as the text sink would write them (each
    row and a blank line), with kilobytes and megabytes; 0 where a stage has none.

    The stages are stacked and pivoted by one aggregation, so there is one shuffle and no join.
    """
    stacked = None
    for name, rows in stages.items():
        part = rows.select("doc_id", F.lit(name).alias("stage"), (F.octet_length(or_empty(F.col(column))) + 2).cast("long").alias("size"))
        stacked = part if stacked is None else stacked.unionByName(part)
    base = documents.select("doc_id", F.lit(None).cast("string").alias("stage"), F.lit(0).cast("long").alias("size"))
    of = lambda name, x: F.coalesce(F.sum(F.when(F.col("stage") == name, x)), F.lit(0))
    sums = [x for n in stages for x in (of(n, 2).cast("long").alias(f"{n}_lines"), of(n, F.col("size")).alias(f"{n}_bytes"))]
    out = base.unionByName(stacked).groupBy("doc_id").agg(*sums)
    for name in stages:
        out = out.withColumn(f"{name}_kb", kilobytes(F.col(f"{name}_bytes"))).withColumn(f"{name}_mb", megabytes(F.col(f"{name}_bytes")))
    return out


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, n_before, n_after, percent), and a total row whose doc_id is null. A document with
    nothing before has a null percent."""
    both = before.select("doc_id", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("doc_id", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return retention_of(both.groupBy("doc_id").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after")))


def retention_of(counts: DataFrame) -> DataFrame:
    """``retention`` from rows (doc_id, n_before, n_after), such as a document's own row has them."""
    sums = counts.rollup("doc_id").agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
    return sums.withColumn("percent", F.round(percent(F.col("n_after"), F.col("n_before")), 4))
