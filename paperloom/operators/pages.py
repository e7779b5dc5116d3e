"""Sections and chunks of paged documents, in one plan for every mode.

A page is a row. Its blocks, the headings among them and the last heading are folded on that row, so
what has to be carried from page to page is one name a page. The names are scanned in two levels: the
last one of each run of PAGES pages, then runs, then the pages of a run. No task sorts the paragraphs
of a document, and a document of very many pages is spread over its runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PRIORITY, SECTION_KEYWORDS, SECTIONS
from ..functions.text import bound, page_blocks, sentences, strip, token_count
from .sections import heading_of, section_of
from .segment import packed

#: Pages of a run, the most that one task scans in order.
PAGES = 1024
MODES = ("basic", "structured", "comprehensive")


def carried_sections(headings: Column, carried: Column) -> Column:
    """The section of each block of a page, as an array: headings (null where a block is none) go on
    to the blocks behind them, and ``carried`` to those before the first. Linear: a heading's name is
    repeated as often as it holds."""

    def filled(names: Column) -> Column:
        at = F.transform(names, lambda name, i: F.struct(i.alias("at"), name.alias("name")))
        first = F.array(F.struct(F.lit(0).alias("at"), carried.alias("name")))
        heads = F.concat(first, F.filter(at, lambda h: h["name"].isNotNull()))

        def runs(h: Column) -> Column:
            def run(head: Column, k: Column) -> Column:
                end = F.coalesce(F.get(h, k + 1)["at"], F.size(names))
                return F.array_repeat(head["name"], end - head["at"])

            return F.flatten(F.transform(h, run))

        return bound(heads, runs)

    return bound(headings, filled)


def _folded(pages: DataFrame, keywords, title_chars: int, keys: tuple[str, ...]) -> DataFrame:
    """Adds blocks, headings (an array beside it) and last (the page's last heading) to pages."""
    rows = pages.select(*keys, "page_no", "text", page_blocks(F.col("text")).alias("blocks"))
    rows = rows.withColumn("headings", F.transform("blocks", lambda b: heading_of(b, keywords, title_chars)))
    return rows.withColumn("last", F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.array_compact("headings")), -1))


def page_sections(pages: DataFrame, keywords=SECTION_KEYWORDS, sections: tuple[str, ...] = SECTIONS, title_chars: int = 200, run_pages: int = PAGES, dealt: bool = False) -> DataFrame:
    """Pages (doc_id, page_no, text) with ``blocks`` and ``sections``, two arrays of the same length:
    each block's section is that of the last heading at or before it, on its page or an earlier one.

    Pages with one number are in the order of their texts; a null number comes first; null text has
    no blocks. A page without blocks stays a row, with empty arrays. See ``assign_sections`` for
    what a heading is. dealt: all pages of a document come in one partition, by the same one shuffle.
    """
    rows = _folded(pages, keywords, title_chars, ("doc_id",)).withColumn("_at", F.coalesce(F.col("page_no").cast("long"), F.lit(-1)))
    rows = rows.withColumn("_run", F.floor(F.col("_at") / run_pages)).withColumn("_tie", F.xxhash64("text"))
    # the last heading of each run: rows of names, not of texts
    latest = F.max_by("last", F.when(F.col("last").isNotNull(), F.struct("_at", "_tie")))
    ends = rows.groupBy("doc_id", "_run").agg(latest.alias("last"))
    earlier = Window.partitionBy("doc_id").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("last", F.last("last", ignorenulls=True).over(earlier)).filter("last IS NOT NULL")
    # what a run begins with stands before its first page, so pages meet it in the window's own shuffle
    both = rows.withColumn("_page", F.lit(True)).unionByName(ends.withColumn("_page", F.lit(False)), allowMissingColumns=True)
    both = both.repartition("doc_id") if dealt else both  # which is enough for the window
    within = Window.partitionBy("doc_id", "_run").orderBy("_page", "_at", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_carried", F.last("last", ignorenulls=True).over(within)).filter("_page")
    names = F.transform(carried_sections(F.col("headings"), F.col("_carried")), lambda name: section_of(name, sections))
    return out.select("doc_id", "page_no", "text", "blocks", names.alias("sections"))


def section_rows(paged: DataFrame) -> DataFrame:
    """(doc_id, page_no, pos, content, section) of the blocks of ``page_sections``; pos is from 0 on
    each page."""
    rows = paged.select("doc_id", "page_no", F.posexplode(F.arrays_zip("blocks", "sections")).alias("pos", "block"))
    return rows.select("doc_id", "page_no", "pos", F.col("block.blocks").alias("content"), F.col("block.sections").alias("section"))


def process_pages(
    pages: DataFrame, mode: str = "comprehensive", keywords=SECTION_KEYWORDS, sections: tuple[str, ...] = SECTIONS, title_chars: int = 200,
    priority: tuple[str, ...] = PRIORITY, max_tokens: int = 200, count=token_count, split=sentences, dealt: bool = False,
) -> DataFrame:
    """(doc_id, name, part, page_no, pos, content): the paragraphs of each output of a document.

    name is ``basic`` (packed chunks of sentences), a section, or ``priority`` (the sections in
    ``priority``, which part numbers from 0; part is 0 elsewhere). Within a name, (part, page_no,
    pos) is the order. mode ``basic`` gives the chunks, ``structured`` the sections and the
    priority text, ``comprehensive`` all of them, from one scan of the pages. dealt: the rows of a
    document come in one partition; its pages are dealt, so a paragraph of two outputs moves once.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    line = lambda name, part, pos, content: F.struct(name.alias("name"), part.alias("part"), pos.alias("pos"), content.alias("content"))
    none = F.lit(0)
    chunks = F.transform(packed(F.transform(split(F.col("text")), lambda s: F.struct(s.alias("text"), count(s).alias("n"))), max_tokens), lambda c, i: line(F.lit("basic"), none, i, strip(c["content"])))
    if mode == "basic":
        pages = pages.repartition("doc_id") if dealt else pages
        return pages.select("doc_id", "page_no", F.explode(chunks).alias("line")).select("doc_id", "line.name", "line.part", "page_no", "line.pos", "line.content")
    paged = page_sections(pages, keywords, sections, title_chars, dealt=dealt)
    pairs = F.arrays_zip(F.col("blocks").alias("content"), F.col("sections").alias("section"))
    lines = F.transform(pairs, lambda b, i: line(b["section"], none, i, b["content"]))
    place = lambda name: F.coalesce(*[F.when(name == p, k) for k, p in enumerate(priority)], F.lit(-1))
    first = F.filter(F.transform(pairs, lambda b, i: line(F.lit("priority"), place(b["section"]), i, b["content"])), lambda x: x["part"] >= 0)
    parts = [lines, first] + ([chunks] if mode == "comprehensive" else [])
    out = paged.select("doc_id", "page_no", F.explode(F.concat(*parts)).alias("line"))
    return out.select("doc_id", "line.name", "line.part", "page_no", "line.pos", "line.content")
