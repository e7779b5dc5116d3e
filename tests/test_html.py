import pytest
from pyspark.sql import functions as F

from paperloom.sources.readers import html_text, unescaped

CASES = [
    ("<p title='a > b'>x</p>", "x"), ('<a href="x>y" b=\'<p>\'>text</a>', "text"), ("&#x4e;&#78;&#x1F600;", "NN😀"), ("&amp;lt; &lt;b&gt;", "&lt; <b>"),
    ("a<script>if (a<b) '</p>'; never closed", "a"), ("a<script src=x>1</script >b<style>p>q{}</STYLE\n>c", "a b c"), ("<script>x</scripty>y</script>z", "z"),
    ("a<!-- <p> -- > still -->b<!-- open", "a b"), ("1 < 2 and 3<4", "1 < 2 and 3<4"), ("<scripted>x</scripted>", "x"), ("a<br/>b<img src=x", "a b"),
    ("&copy; &unknown; &; & &#0; &#xD800; &#1114112; &#xZZ;", "© &unknown; &; & � � � &#xZZ;"), ("&nbsp;x&nbsp;", "x"), (None, ""), ("", ""),
    ("<!DOCTYPE html><?xml v?>t", "t"), ("<template><p>no</p></template>yes<noscript>no</noscript>", "yes"), ('<p a="open>rest', ""), ("&Mu; &mu;", "&Mu; μ"),
    ("<" * 1000, "<" * 1000), ("<p " + "a='b' " * 3000 + ">x", "x"),
]


def test_pages(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, html string")
    got = {r.i: r.text for r in rows.select("i", html_text(F.col("html")).alias("text")).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}


@pytest.mark.parametrize("size", [200_000])
def test_long_pages(spark, size):
    pages = ["<p>" + "x " * size, "<script>" + "x<" * size, "<!--" + "-" * size, "&" * size, "a" * size, "<p a='" + "x" * size + "'>y"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r.text for r in rows.select("i", html_text(F.col("html")).alias("text")).collect()}
    assert got == {0: ("x " * size).strip(), 1: "", 2: "", 3: "&" * size, 4: "a" * size, 5: "y"}


def test_references_are_read_once(spark):
    x = spark.createDataFrame([("&amp;amp;&amp;#65;&#65;",)], "x string").select(unescaped(F.col("x"))).first()[0]
    assert x == "&amp;&#65;A"
