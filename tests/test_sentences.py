import math
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators.pages import process_pages
from paperloom.operators.sentences import abbreviations, scored, sentences_with, split_sentences, stop_counts

PLAIN = ["The reaction ran for long hours.", "We saw a clear product there.", "Nobody found any other result.", "It was heated and stirred again.", "Too many hours were left here, a lot of care again, the setup and result there slowly done here."]
SHORT = [
    "Smith et al. found more of it here.", "See Fig. 3 for the whole setup.", "Use a base, e.g. sodium hydroxide, with care.", "It follows Jones et al. and others too.",
    "As Fig. 12 shows, heat helps a lot.", "Some salts, e.g. sodium chloride, were left.",
]


def corpus(spark):
    return spark.createDataFrame([(i, " ".join(PLAIN[(i + k) % 5] + " " + SHORT[(i * 3 + k) % 6] for k in range(4))) for i in range(60)], "doc_id int, text string")


def test_abbreviations_are_learned_without_labels(spark):
    assert {r.word for r in abbreviations(corpus(spark)).collect()} == {"al", "fig", "e.g"}


def test_counts_and_score(spark):
    docs = spark.createDataFrame([('("No. 5", no No. al.) x.y. 12. -- é. É',), (None,), ("",)], "text string")
    got = {r.word: (r.n_stop, r.n_plain) for r in stop_counts(docs).collect()}
    assert got == {"no": (2, 1), "al": (1, 0), "x.y": (1, 0), "é": (1, 1)}
    score = {r.word: r.score for r in scored(stop_counts(docs)).collect()}
    share = 5 / 7
    assert score["x.y"] == pytest.approx(2 * math.log(0.99 / share) * math.exp(-2) * 2)
    assert score["no"] == pytest.approx((2 * 2 * math.log(0.99 / share) + 2 * math.log(0.01 / (1 - share))) * math.exp(-2) / 2)
    assert scored(stop_counts(docs.limit(0))).collect() == []


@pytest.mark.parametrize("listed", [5000, 1])
def test_sentences_are_not_cut_after_abbreviations(spark, listed):
    docs = corpus(spark)
    rows = split_sentences(docs, abbreviations(docs), listed=listed).collect()
    assert len(rows) == 60
    for r in rows:
        assert r.sentences == [s for k in range(4) for s in (PLAIN[(r.doc_id + k) % 5], SHORT[(r.doc_id * 3 + k) % 6])]


@pytest.mark.parametrize("listed", [5000, 0])
def test_edges_and_other_columns(spark, listed):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, " \n ", "k"), (4, "One. Two al.", "k"), (4, "One. Two al.", "k"), (5, "al. (al.) end", "k")], "_own int, `the.text` string, word string")
    found = spark.createDataFrame([("al",)], "word string")
    rows = split_sentences(docs, found, "the.text", listed=listed)
    got = sorted(((r["_own"], r.sentences) for r in rows.collect()), key=repr)
    assert rows.columns == [*docs.columns, "sentences"]
    assert got == [(1, []), (2, []), (3, [" \n "]), (4, ["One.", "Two al."]), (4, ["One.", "Two al."]), (5, ["al. (al.) end"])]


def test_chunks_with_learned_borders(spark):
    pages = corpus(spark).withColumn("page_no", F.lit(0))
    plain = process_pages(pages, "basic", max_tokens=1).groupBy("doc_id").count().agg(F.sum("count")).first()[0]
    learned = process_pages(pages, "basic", max_tokens=1, split=lambda t: sentences_with(t, lambda w: w.isin("al", "fig", "e.g"))).count()
    assert learned == 60 * 8 < plain


def test_a_long_word_is_looked_at_once(spark):
    """The last word of a piece is found without a try at each of its letters."""
    text = "One etc. " + "x" * 300_000 + "! Two vs. three. «U.S.. End."
    begun = time.time()
    rows = spark.createDataFrame([(text,)], "text string").select(sentences_with(F.col("text"), lambda w: w.isin("etc", "vs", "u.s.")))
    assert rows.first()[0] == ["One etc. " + "x" * 300_000 + "!", "Two vs. three.", "«U.S.. End."]
    assert time.time() - begun < 10
