"""Sentence borders with abbreviations that are learned from the texts themselves.

A full stop ends a sentence, or it belongs to an abbreviation. Which words are abbreviations is told
without labels, after Kiss and Strunk: a word that nearly always has its full stop is one (the
log-likelihood ratio of that against a chance stop), the more so if it is short, has stops inside, and
is not seen without. All that is needed are two counts a word, from one aggregation over all texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, bound, or_empty

#: Score from which a word is an abbreviation, and the share of stops that an abbreviation has.
LEAST, SURE = 0.3, 0.99
#: Abbreviations that travel with the plan as a list; more are joined.
LISTED = 5_000

Known = Callable[[Column], Column]


def words_with_stops(text: Column) -> Column:
    """Words of a text with their last full stop, lower-cased, as an array: without quotes and
    brackets in front, and without other marks behind. Only what has a letter counts."""
    return F.filter(_bare_words(text), lambda w: w.rlike(r"\p{L}"))


def _bare_words(text: Column) -> Column:
    """``words_with_stops`` with what has digits and no letter. What is left behind a word, up to the
    next white space, has no letter, digit or stop, so no second word begins there."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"[\p{L}\p{N}](?:\S*[\p{L}\p{N}.])?"), F.lit(0))


def stop_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n_stop, n_plain): how often a word is followed by a full stop and how often not."""
    words = docs.select(F.explode(_bare_words(F.col(f"`{text_col}`"))).alias("w"))
    stop = F.col("w").endswith(".")
    word = F.when(stop, F.expr("substring(w, 1, length(w) - 1)")).otherwise(F.col("w"))
    counts = words.select(word.alias("word"), stop.cast("long").alias("stop")).groupBy("word").agg(F.sum("stop").alias("n_stop"), F.sum(1 - F.col("stop")).alias("n_plain"))
    return counts.filter(F.col("word").rlike(r"\p{L}"))  # looked at once a word, not at each of its places


def scored(counts: DataFrame) -> DataFrame:
    """Adds ``score`` to ``stop_counts``. One row of totals is broadcast."""
    totals = counts.agg(F.sum("n_stop").alias("_stops"), F.sum(F.col("n_stop") + F.col("n_plain")).alias("_all"))
    rows = counts.crossJoin(F.broadcast(totals))
    share = F.least(F.greatest(F.col("_stops") / F.col("_all"), F.lit(1e-9)), F.lit(1 - 1e-9))
    # log-likelihood of the word's stops: as an abbreviation's against as any word's
    ratio = 2 * (F.col("n_stop") * (F.log(F.lit(SURE)) - F.log(share)) + F.col("n_plain") * (F.log(F.lit(1 - SURE)) - F.log(1 - share)))
    inside = F.char_length("word") - F.char_length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.char_length("word") - inside
    weight = F.exp(-letters.cast("double")) * (inside + 1) * F.pow(letters.cast("double"), -F.col("n_plain").cast("double"))
    return rows.withColumn("score", ratio * weight).drop("_stops", "_all")


def abbreviations(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(word, n_stop, n_plain, score) of the abbreviations of the texts."""
    return scored(stop_counts(docs, text_col)).filter((F.col("score") >= least) & (F.col("n_stop") > 0))


def last_word(piece: Column) -> Column:
    """The word that a piece ends with, as in ``stop_counts``; null unless it ends with a full stop."""
    # what stands before the last white space goes at one go, so no word but the last is looked at
    last = F.regexp_replace(piece, r"(?s)^.*\s", "")
    tail = lambda w: F.when(F.char_length(w) > 1, F.regexp_replace(F.lower(F.left(w, F.char_length(w) - 1)), r"^[^\p{L}\p{N}]+", ""))
    return F.when(F.endswith(piece, F.lit(".")), bound(last, tail))


def sentences_with(text: Column, known: Known) -> Column:
    """Sentences as an array: cut after ``.``, ``!`` or ``?`` and white space, but not after a word
    that ``known`` holds to be an abbreviation. Null text has none; blank pieces are left out; the
    parts of a sentence are joined by one space."""
    pieces = F.filter(F.split(or_empty(text), SENTENCE_END), lambda s: s != "")

    def joined(parts: Column) -> Column:
        goes_on = F.transform(parts, lambda p: F.coalesce(known(last_word(p)), F.lit(False)))
        begins = bound(goes_on, lambda on: F.filter(F.transform(parts, lambda p, i: F.when((i == 0) | ~F.get(on, i - 1), i)), lambda i: i.isNotNull()))

        def cut(starts: Column) -> Column:
            return F.transform(starts, lambda at, k: F.array_join(F.slice(parts, at + 1, F.coalesce(F.get(starts, k + 1), F.size(parts)) - at), " "))

        return bound(begins, cut)

    return bound(pieces, joined)


def split_sentences(docs: DataFrame, found: DataFrame, text_col: str = "text", out_col: str = "sentences", listed: int = LISTED) -> DataFrame:
    """Adds the sentences of each text, cut with the abbreviations ``found`` (word, ...).

    Up to ``listed`` abbreviations are part of the expression, and nothing is shuffled. Beyond that
    number each text's own last words are joined with them, and what is found goes back to the text.
    """
    words = [r.word for r in found.select("word").limit(listed + 1).collect()]
    text = F.col(f"`{text_col}`")
    if len(words) <= listed:
        return docs.withColumn(out_col, sentences_with(text, lambda w: w.isin(*words) if words else F.lit(False)))
    # the columns travel inside one, so that no name can clash
    rows = docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.col("_row")[text_col]
    ends = F.array_compact(F.array_distinct(F.transform(F.split(or_empty(text), SENTENCE_END), last_word)))
    own = rows.select("_key", F.explode(ends).alias("word")).join(found.select("word"), "word").groupBy("_key").agg(F.collect_set("word").alias("_own"))
    cut = rows.join(own, "_key", "left").withColumn("_cut", sentences_with(text, lambda w: F.array_contains(F.col("_own"), w)))
    return cut.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != out_col], F.col("_cut").alias(out_col))
