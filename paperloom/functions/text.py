"""Text expressions. All are built-in functions, so they stay inside the JVM's generated code."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the four separators before the blank.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: White space behind ``.``, ``!`` or ``?``: the mark is looked for where white space is.
SENTENCE_END = r"\s(?<=[.!?]\s)\s*"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: the variable of a lambda, as a
    plain expression would be written out, and evaluated, at each of its places."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends (``trim`` takes only U+0020)."""
    return F.btrim(x, F.lit(SPACES))


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def not_blank(x: Column) -> Column:
    return strip(or_empty(x)) != ""


def contains_any(x: Column, words: Iterable[str]) -> Column:
    """Whether the lower-cased text holds one of the words as a plain substring. A word with a
    capital letter can therefore never be found."""
    found = F.lit(False)
    low = F.lower(x)
    for word in words:
        found = found | F.contains(low, F.lit(word))
    return found


def starts_yes(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)).startswith("yes"), F.lit(False))


def segments(text: Column) -> Column:
    """Paragraphs as an array: lines are stripped, blank ones part paragraphs, and the lines of a
    paragraph are joined with one space. Null text gives no paragraph."""
    lines = F.replace(F.replace(or_empty(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # patterns begin at a line break, so that most of a text is passed over
    pieces = F.split(strip(lines), r"(?U)\n(?:[^\S\n]*\n)+")
    blank = "".join(c for c in SPACES if c not in "\x1c\x1d\x1e\x1f")

    trimmed = lambda x: F.btrim(x, F.lit(blank))

    def joined(piece: Column) -> Column:
        # a run of blanks is tried from its first one only
        return F.when(F.contains(piece, F.lit("\n")), F.regexp_replace(piece, r"(?U)(?<![^\S\n])[^\S\n]*+\n[^\S\n]*", " ")).otherwise(piece)

    return F.filter(F.transform(F.transform(pieces, trimmed), joined), lambda p: p != "")


def page_blocks(text: Column) -> Column:
    """A page's blocks as an array: cut at exactly two line breaks, stripped, without blank ones."""
    return F.filter(F.transform(F.split(or_empty(text), "\n\n"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Sentences as an array, cut after ``.``, ``!`` or ``?`` and white space."""
    return F.filter(F.split(or_empty(text), SENTENCE_END), lambda s: s != "")


def token_count(sentence: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_count(sentence, F.lit(r"(?U)\w+|[^\w\s]"))


def word_count(sentence: Column) -> Column:
    return F.regexp_count(sentence, F.lit(r"\S+"))


def base_name(path: Column) -> Column:
    """File name without folders and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def preview(x: Column, n: int) -> Column:
    return F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def kilobytes(size: Column) -> Column:
    return F.round(size / 1024, 2)


def megabytes(size: Column) -> Column:
    return F.round(size / (1024 * 1024), 2)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, null for an empty whole."""
    return F.try_divide(part * 100.0, whole.cast("double"))


def marker_pattern(markers: Iterable[str]) -> str:
    """A case-insensitive, word-bounded alternation. Borders are those of ASCII words, which two
    engines agree on also next to accented letters."""
    words = "|".join(markers)
    return rf"(?i)(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])"
