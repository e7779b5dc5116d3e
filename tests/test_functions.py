import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import json as J
from paperloom.functions import text as T


def column(spark, values, expression, name="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col(name)).alias("out")).collect()]


def paragraphs(text):
    out, current = [], []
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip():
            current.append(line.strip())
        elif current:
            out.append(" ".join(current))
            current = []
    return out + ([" ".join(current)] if current else [])


def test_segments_follow_lines(spark):
    random.seed(1)
    texts = ["", None, "\n \n", "a", "a\r\nb\r\n\r\nc", "  a \n\t\n b \n c"]
    texts += ["".join(random.choice("ab \n\t\r") for _ in range(random.randint(0, 40))) for _ in range(200)]
    assert column(spark, texts, T.segments) == [paragraphs(t) for t in texts]


def test_strip_is_unicode(spark):
    assert column(spark, ["  a b ", "\t\n", None], T.strip) == ["a b", "", None]


def test_keyword_facts(spark):
    assert column(spark, ["a summary", "aluminium", "5 mL/min", None], lambda x: T.contains_any(F.coalesce(x, F.lit("")), ["mm"])) == [True, False, False, False]
    assert column(spark, ["5 mL/min", "5 ml/min"], lambda x: T.contains_any(x, ["mL/min"])) == [False, False]


def test_answers_and_names(spark):
    assert column(spark, [" yes.", "No", "", None, "\nYES"], T.starts_yes) == [True, False, False, False, True]
    assert column(spark, ["/a/b.c.txt", "x", "/a/.hidden"], T.base_name) == ["b.c", "x", ".hidden"]
    assert column(spark, ["abcd", "ab", None], lambda x: T.preview(x, 3)) == ["abc...", "ab", None]


BLOCKS = ["a {1} b {22 {3} } c {4}", "} {1}", "no brace", "", None, "{a}{b}", "{{}", "x } y { z", '{"s": "}"}', "}{ {1} }"]


def longest(text):
    text = text or ""
    depth, begin, best = 0, -1, ""
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                begin = i
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and begin >= 0:
                if i + 1 - begin > len(best):
                    best = text[begin : i + 1]
                begin = -1
    if best:
        return best
    a, b = text.find("{"), text.rfind("}")
    return text[a : b + 1] if -1 < a < b else text


def test_longest_block(spark):
    random.seed(2)
    texts = BLOCKS + ["".join(random.choice("{}ab") for _ in range(random.randint(0, 25))) for _ in range(300)]
    assert column(spark, texts, J.longest_block) == [longest(t) for t in texts]


MALFORMED = """Here you are:
{ "reaction_summary": { // main part
  "reaction_type": "...", /* unknown */
  products: [ {"name": "x", "yield_optimal": "99.6", "unit": "%"}, ],
  "metrics": {"conversion": ..., "yield": "95", "unit": "%"},
}}
Note: done. Best regards"""


def test_sanitizer_repairs(spark):
    clean = column(spark, [MALFORMED], J.sanitize)[0]
    summary = json.loads(clean)["reaction_summary"]
    assert summary["reaction_type"] is None and summary["metrics"] == {"conversion": None, "yield": 95, "unit": "%"}
    assert summary["products"] == [{"name": "x", "yield_optimal": 99.6, "unit": "%"}]
    parsed = column(spark, [clean, "{", None], J.parsed_summary)
    assert parsed[0]["products"][0]["yield_optimal"] == 99.6 and parsed[1:] == [None, None]


def test_repaired_keeps_what_cannot_be_repaired(spark):
    assert column(spark, ['{"a": 1,}', '{"a": "007",}', "plain"], J.repaired) == ['{"a": 1}', '{"a": "007",}', "plain"]


def test_markdown(spark):
    assert column(spark, ["### Step 1: look\n```json\n{}\n```\n### end", None], J.strip_markdown) == ["{}", ""]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet='{}[]",:/*. a1\n', max_size=40), min_size=1, max_size=20))
def test_sanitizer_never_fails(spark, texts):
    out = column(spark, texts, J.sanitize)
    assert all(isinstance(x, str) for x in out)


@pytest.mark.parametrize("part, whole, expected", [(1.0, 4.0, 25.0), (1.0, 0.0, None)])
def test_percent(spark, part, whole, expected):
    assert spark.range(1).select(T.percent(F.lit(part), F.lit(whole))).first()[0] == expected
