"""Sections of a paper, carried forward from their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PRIORITY, SECTION_KEYWORDS, SECTIONS
from ..functions.text import contains_any


def heading_of(content: Column, keywords=SECTION_KEYWORDS, title_chars: int = 200) -> Column:
    """The section that a paragraph is a heading of, or null."""
    short = F.char_length(content) < title_chars
    heading = F.lit(None).cast("string")
    for name, words in keywords:  # a later section overrides an earlier one
        heading = F.when(short & contains_any(content, words), name).otherwise(heading)
    return heading


def section_of(current: Column, sections: tuple[str, ...] = SECTIONS) -> Column:
    """The section under a heading: 'other' before any, and for one that is not in ``sections``."""
    return F.when(current.isin(*sections), current).otherwise("other")


def assign_sections(rows: DataFrame, keywords=SECTION_KEYWORDS, sections: tuple[str, ...] = SECTIONS, title_chars: int = 200, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Adds ``section``: that of the last heading at or before the row.

    A paragraph under title_chars that holds a keyword is a heading; if it holds words of several
    sections the last in keyword order counts. Before any heading, and for a heading whose section
    is not in ``sections``, it is 'other'. One window by document; ``order`` may lead with a page.
    """
    so_far = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    current = F.last(heading_of(F.col("content"), keywords, title_chars), ignorenulls=True).over(so_far)
    return rows.withColumn("section", section_of(current, sections))


def section_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n_paragraphs"))


def priority_content(rows: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """(doc_id, priority, pos, content) of the sections in ``priority``, which numbers them from 0.
    Sorting by (priority, pos) within a document gives its priority text."""
    place = F.lit(None).cast("int")
    for i, name in enumerate(priority):
        place = F.when(F.col("section") == name, i).otherwise(place)
    return rows.withColumn("priority", place).filter("priority IS NOT NULL").select("doc_id", "priority", "pos", "content")
