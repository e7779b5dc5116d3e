"""Sources: whole text files, PDF pages, HTML and markdown tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, bound, or_empty, segments, strip

PageReader = Callable[[bytes], list[str]]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): one row a file, undecodable bytes dropped."""
    rows = spark.read.text(path, wholetext=True)
    where = F.input_file_name()
    return rows.select(base_name(where).alias("doc_id"), where.alias("path"), F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("text"))


def paragraphs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, content) from whole texts; pos counts from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(segments(F.col(text_col))).alias("pos", "content"))


def _pymupdf_pages(raw: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=raw, filetype="pdf") as document:
        return [page.get_text() for page in document]


def read_pdf_pages(spark: SparkSession, path: str, reader: PageReader = _pymupdf_pages) -> DataFrame:
    """(doc_id, page_no, text) of the pages that are not blank. The decoder is a function from a
    file's bytes to its page texts; the default needs PyMuPDF."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    files = files.select(base_name(F.col("path")).alias("doc_id"), "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"], batch["content"], strict=True):
                found = [(doc_id, i, text) for i, text in enumerate(reader(raw)) if text.strip()]
                yield pd.DataFrame(found, columns=["doc_id", "page_no", "text"])

    return files.mapInPandas(pages, "doc_id string, page_no int, text string")


# Named entities that pages use most, with their code points.
ENTITIES = {
    "lt": 0x3C, "gt": 0x3E, "amp": 0x26, "quot": 0x22, "apos": 0x27, "nbsp": 0x20, "copy": 0xA9, "reg": 0xAE, "trade": 0x2122, "deg": 0xB0,
    "plusmn": 0xB1, "micro": 0xB5, "middot": 0xB7, "times": 0xD7, "divide": 0xF7, "laquo": 0xAB, "raquo": 0xBB, "ndash": 0x2013, "mdash": 0x2014,
    "lsquo": 0x2018, "rsquo": 0x2019, "ldquo": 0x201C, "rdquo": 0x201D, "bull": 0x2022, "hellip": 0x2026, "euro": 0x20AC, "pound": 0xA3, "sect": 0xA7,
    "alpha": 0x3B1, "beta": 0x3B2, "gamma": 0x3B3, "delta": 0x3B4, "lambda": 0x3BB, "mu": 0x3BC, "minus": 0x2212, "rarr": 0x2192, "larr": 0x2190, "le": 0x2264, "ge": 0x2265,
    "auml": 0xE4, "ouml": 0xF6, "uuml": 0xFC, "szlig": 0xDF, "eacute": 0xE9, "egrave": 0xE8, "agrave": 0xE0, "ccedil": 0xE7, "ntilde": 0xF1,
}

#: What of a tag follows its name: quoted values may hold ``>``, and a tag may be left open.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+>?"""


def _raw(name: str) -> str:
    """An element whose text is no markup: up to its end tag, or to the end of the page."""
    return rf"""<{name}(?=[\s/>]){_ATTRIBUTES}(?:(?!</{name}(?=[\s/>]))[\s\S])*+(?:</{name}[^>]*+>?)?"""


#: What a page's tokeniser reads besides text, at a ``<``, in this order: comments, raw elements,
#: declarations, and tags. A ``<`` before anything else is text.
MARKUP = rf"""(?i)<!--(?:(?!-->)[\s\S])*+(?:-->)?|{"|".join(map(_raw, ("script", "style", "template", "noscript")))}|<[!?][^>]*+>?|</?[a-z][^\s/>]*+{_ATTRIBUTES}"""
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    sound = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def unescaped(x: Column) -> Column:
    """Numeric and named character references read, once: ``&amp;lt;`` gives ``&lt;``. What is no
    reference, or none of ENTITIES, stays as it is."""
    known = F.create_map(*[F.lit(v) for pair in ENTITIES.items() for v in pair])

    def read(part: Column) -> Column:
        def by_name(name: Column) -> Column:
            digits = F.conv(F.regexp_replace(name, "^#[xX]?", ""), 16, 10)
            plain = F.regexp_replace(name, "^#", "")
            code = F.when(name.rlike("^#[xX]"), digits.try_cast("bigint")).when(name.startswith("#"), plain.try_cast("bigint")).otherwise(F.try_element_at(known, name).cast("bigint"))
            rest = F.substring(part, F.char_length(name) + 2, F.char_length(part))
            return bound(code, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(_character(c), rest)))

        return bound(F.regexp_extract(part, _REFERENCE, 1), by_name)

    # every part but the first stood behind an ampersand
    parts = F.split(x, "&")
    return bound(parts, lambda p: F.array_join(F.transform(p, lambda part, i: F.when(i == 0, part).otherwise(read(part))), ""))


def html_text(html: Column) -> Column:
    """The visible text of an HTML column, white space joined.

    The page is read once from left to right, by one pattern over its markup: comments, raw elements
    (scripts and the like, up to their own end tag), declarations and tags, whose quoted values may hold
    anything. What is left open reaches to the page's end. Then character references are read.
    """
    x = unescaped(F.regexp_replace(or_empty(html), MARKUP, " "))
    return strip(F.regexp_replace(x, r"\s+", " "))


def html_to_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return pages.select(F.col(id_col), html_text(F.col(html_col)).alias("text"))


TABLE_COLUMNS = ("precursor", "substrate", "temperature", "products", "dimensions")


def markdown_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = TABLE_COLUMNS) -> DataFrame:
    """(doc_id, table_no, row_no, columns...) of the pipe tables in a text; all strings.

    A rule row (``|---|``) follows a table's header; each header starts a table. Rows with more
    cells lose the last ones, shorter ones end in nulls.
    """
    lines = F.split(F.regexp_replace(or_empty(F.col(text_col)), r"\r\n?", "\n"), "\n")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.transform(lines, strip)).alias("line", "row")).filter("row LIKE '|%|' AND length(row) > 1")
    cells = F.transform(F.split(F.expr("substring(row, 2, length(row) - 2)"), r"\|"), strip)
    order = Window.partitionBy("doc_id").orderBy("line")
    rule = F.col("row").rlike(r"^\|[\s:|-]*-[\s:|-]*\|$")
    rows = rows.withColumn("rule", rule).withColumn("header", F.coalesce(F.lead("rule").over(order), F.lit(False)) & ~F.col("rule"))
    rows = rows.withColumn("table_no", F.sum(F.col("header").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter("NOT rule AND NOT header AND table_no > 0")
    within = Window.partitionBy("doc_id", "table_no").orderBy("line")
    return rows.withColumn("cells", cells).select("doc_id", "table_no", F.row_number().over(within).alias("row_no"), *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])
