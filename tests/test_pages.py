import pytest
from pyspark.sql import functions as F

from paperloom.config import Config
from paperloom.operators.pages import page_sections, process_pages, section_rows
from paperloom.operators.sections import assign_sections
from paperloom.plans.pipeline import Pipeline

PAGES = [
    ("a", 0, "intro\n\nAbstract\n\nbody"), ("a", 1, "goes on"), ("a", 2, ""), ("a", 3, None), ("a", 4, "still\n\n \n\nRESULTS and methods\n\nlast"),
    ("a", 5, "Flow setup\n\nunder setup"), ("a", 900, "far away"), ("b", 7, "no heading"), (None, 1, "Conclusion"), (None, 2, "after"),
]
SCHEMA = "doc_id string, page_no int, text string"


def carried(rows, sections=("abstract", "conclusion", "results", "introduction", "methods", "other")):
    """The rule in plain Python, page after page."""
    out, current = [], {}
    for doc, page, text in rows:
        pos = 0
        for block in (b.strip() for b in (text or "").split("\n\n")):
            if not block:
                continue
            if len(block) < 200:
                for name, words in Config().section_keywords:
                    if any(w in block.lower() for w in words):
                        current[doc] = name
            now = current.get(doc, "other")
            out.append((doc, page, pos, block, now if now in sections else "other"))
            pos += 1
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "page_no", "pos", "content", "section").collect()), key=repr)


@pytest.mark.parametrize("run_pages", [1, 2, 1024])
def test_headings_carry_over_pages_and_runs(spark, run_pages):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert found(section_rows(page_sections(pages, run_pages=run_pages))) == carried(PAGES)


def test_equals_the_window_over_paragraphs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit(0).alias("page_no"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    rows = section_rows(page_sections(docs))
    assert rows.count() and rows.join(assign_sections(rows.drop("section")).withColumnRenamed("section", "other"), ["doc_id", "pos"]).filter("section <> other").count() == 0


def test_null_and_repeated_page_numbers(spark):
    rows = [("d", None, "Abstract"), ("d", 1, "x"), ("d", 1, "x"), ("d", 2, "y")]
    assert {r.section for r in section_rows(page_sections(spark.createDataFrame(rows, SCHEMA))).collect()} == {"abstract"}
    assert page_sections(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_cross_one_exchange(spark):
    plan = page_sections(spark.createDataFrame(PAGES, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 3  # pages, and twice the names of runs


def test_three_modes_from_one_plan(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    modes = {m: sorted((tuple(r) for r in Pipeline(Config()).process_pages(pages, m).collect()), key=repr) for m in ("basic", "structured", "comprehensive")}
    assert modes["comprehensive"] == sorted(modes["basic"] + modes["structured"], key=repr)
    assert {r[1] for r in modes["basic"]} == {"basic"} and modes["basic"]
    first = [(r[2], r[5]) for r in sorted(modes["structured"], key=lambda r: (r[2], r[3], r[4])) if r[0] == "a" and r[1] == "priority"]
    assert first == [(0, "Abstract"), (0, "body"), (0, "goes on"), (0, "still")] and all(r[2] == 0 for r in modes["structured"] if r[1] != "priority")
    with pytest.raises(ValueError):
        process_pages(pages, "other")
