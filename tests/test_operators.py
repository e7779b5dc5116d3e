import math
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from paperloom.config import Config
from paperloom.operators import backends, metrics, models
from paperloom.operators.clean import truncate_back_matter, truncated
from paperloom.operators.sections import assign_sections, priority_content, section_counts
from paperloom.operators.segment import pack_chunks
from paperloom.operators.similarity import cosine, embed_and_compare, hashed_embedding, hashed_similarity, term_similarity, top_by_group, top_rows
from paperloom.plans.pipeline import Pipeline
from paperloom.sources.readers import html_to_text, markdown_tables, paragraphs, read_pdf_pages, read_text
from paperloom.sources.sinks import document_texts, output_name, remaining, write_sections, write_text
from paperloom.streaming.ingest import read_text_stream, run_stream


def rows_of(spark, documents):
    return spark.createDataFrame([(d, p, c) for d, parts in documents.items() for p, c in enumerate(parts)], "doc_id string, pos int, content string")


BACK = {
    "first": ["Acknowledgements we thank", "x"], "middle": ["a", "see DATA AVAILABILITY here", "b"], "last": ["a", "Conflicts of interest"],
    "two": ["a", "Acknowledgement", "Data availability"], "none": ["a", "Acknowledgments are spelled so", "References"], "inside": ["xAcknowledgementsx", "b"],
}


def test_back_matter_by_rows_and_by_array(spark):
    by_rows = {(r.doc_id, r.pos): r.content for r in truncate_back_matter(rows_of(spark, BACK)).collect()}
    arrays = spark.createDataFrame(list(BACK.items()), "doc_id string, parts array<string>")
    by_array = {(r.doc_id, r.pos): r.content for r in arrays.select("doc_id", F.posexplode(truncated(F.col("parts"))).alias("pos", "content")).collect()}
    assert by_rows == by_array
    assert by_rows["first", 0] == "" and ("first", 1) not in by_rows and by_rows["middle", 1] == "see " and ("middle", 2) not in by_rows
    assert by_rows["last", 1] == "" and ("two", 2) not in by_rows and len([k for k in by_rows if k[0] in ("none", "inside")]) == 5


def test_sections(spark):
    parts = ["intro text", "Summary of findings", "body", "Flow setup", "body", "x" * 191 + " abstract", "x" * 190 + " abstract", "DoE", "Introduction"]
    got = [r.section for r in assign_sections(rows_of(spark, {"d": parts})).orderBy("pos").collect()]
    assert got == ["other", "results", "results", "other", "other", "other", "abstract", "abstract", "abstract"]
    counts = {r.section: r.n_paragraphs for r in section_counts(assign_sections(rows_of(spark, {"d": parts}))).collect()}
    assert counts == {"other": 4, "results": 2, "abstract": 3}
    order = [(r.priority, r.pos) for r in priority_content(assign_sections(rows_of(spark, {"d": parts}))).orderBy("priority", "pos").collect()]
    assert order == [(0, 6), (0, 7), (0, 8), (2, 1), (2, 2)]


def test_section_carries_over_pages(spark):
    rows = spark.createDataFrame([("d", 1, 0, "Abstract"), ("d", 2, 0, "goes on")], "doc_id string, page int, pos int, content string")
    assert [r.section for r in assign_sections(rows, order=("page", "pos")).orderBy("page").collect()] == ["abstract", "abstract"]


def test_packing(spark):
    sentence = lambda n: " ".join(["w"] * (n - 1)) + " e."
    pages = spark.createDataFrame([("d", 1, f"{sentence(150)} {sentence(48)} {sentence(10)}"), ("d", 2, sentence(300) + " a."), ("d", 3, ""), ("d", 4, None)], "doc_id string, page_no int, text string")
    got = [(r.page_no, r.chunk_no, r.n_tokens) for r in pack_chunks(pages).orderBy("page_no", "chunk_no").collect()]
    assert got == [(1, 0, 151 + 49), (1, 1, 11), (2, 0, 301), (2, 1, 2)]
    joined = " ".join(r.content for r in pack_chunks(pages).filter("page_no = 1").orderBy("chunk_no").collect())
    assert joined == pages.first().text


def test_cosine_and_top(spark):
    rows = spark.createDataFrame([("d", i, s) for i, s in enumerate([0.5, float("nan"), 0.9, 0.5, None])], "doc_id string, pos int, similarity double")
    assert [(r.rank, r.pos) for r in top_by_group(rows, 3).orderBy("rank").collect()] == [(1, 2), (2, 0), (3, 3)]
    assert [r.pos for r in top_rows(rows, 10).collect()] == [2, 0, 3, 1, 4] and top_by_group(rows, 0).count() == 0
    zero = spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0]
    assert zero == 0.0


def test_top_n_is_cut_before_the_shuffle(spark):
    rows = rows_of(spark, {"d": ["a"]}).withColumn("similarity", F.lit(1.0))
    plan = top_by_group(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_hashed_similarity_is_the_cosine(spark):
    texts = spark.createDataFrame([("the flow the reactor",), ("",), ("FLOW flow x",)], "t string")
    reference = hashed_embedding(F.lit("flow reactor flow"), 16)
    for r in texts.select(cosine(hashed_embedding(F.col("t"), 16), reference).alias("a"), hashed_similarity(F.col("t"), reference, 16).alias("b")).collect():
        assert math.isclose(r.a, r.b, abs_tol=1e-12)
    got = [r[0] for r in texts.select(term_similarity(F.col("t"), "flow reactor")).collect()]
    assert math.isclose(got[0], 2 / (math.sqrt(6) * math.sqrt(2))) and got[1] == 0
    assert {"content_embedding", "similarity"} <= set(embed_and_compare(rows_of(spark, {"d": ["flow"]}), "flow").columns)


def fake(answers):
    return lambda: lambda prompts, contents, n: [answers(c) for c in contents]


def test_gate_skips_the_model(spark):
    def never(content):
        if "reactor" in content or "summary" in content:
            raise AssertionError("asked")
        return {"y": " yes.", "n": "No", "e": ""}[content]

    rows = rows_of(spark, {"d": ["a reactor", "summary", "y", "n", "e", "raises"]})
    got = {r.content: r.classification for r in models.classify(rows, fake(never)).collect()}
    assert got == {"a reactor": "Yes", "summary": "Yes", "y": "Yes", "n": "No", "e": "No", "raises": "No"}


def test_abstracts_and_summaries(spark):
    def answer(content):
        if content == "bad":
            raise RuntimeError("broken")
        return "" if content == "empty" * 200 else f"note {{{content}}} end"

    rows = rows_of(spark, {"d": ["x", "empty" * 200, "bad"]})
    got = {r.pos: (r.abstract, r.error) for r in models.abstracts(rows, fake(answer)).collect()}
    assert got == {0: ("note {x} end", None), 1: (("empty" * 200)[:400], None), 2: (None, "broken")}
    out = {r.pos: r for r in models.summaries(rows, fake(answer), input_col="content").withColumn("text", models.compatible("summarized")).collect()}
    assert out[0].summarized == "{x}" and out[1].summarized == "" and out[2].text == "Error: broken"


def test_document_concat_and_merge(spark):
    rows = rows_of(spark, {"d": ["b" * 10, "  ", "c" * 10], "e": [""]}).withColumn("rank", F.col("pos"))
    got = models.document_concat(rows, "content", 15).collect()
    assert [(r.doc_id, r.combined) for r in got] == [("d", "b" * 10 + "\n\n" + "c" * 3)]
    merged = models.document_summaries(rows, fake(lambda c: '```json\n{"reaction_summary": {"reaction_type": "...",}}\n```'), column="content").first()
    assert merged.overall == '{"reaction_summary": {"reaction_type": null}}'


def test_fallback(spark):
    rows = rows_of(spark, {"a": ["x", "y"], "b": ["z"]}).withColumn("classification", F.when(F.col("content") == "x", "Yes").otherwise("No"))
    assert sorted((r.doc_id, r.pos) for r in models.relevant_or_all(rows).collect()) == [("a", 0), ("b", 0)]


def test_extractor_example():
    got = backends.extracted("Flow rate 0.1 mL/min, T=80 °C in a 0.5 mm coil; yield 82%.")["reaction_summary"]
    assert got["conditions"] == [{"type": "temperature", "value": "80 °C"}, {"type": "flow_rate_total", "value": "0.1 mL/min"}]
    assert got["reactor"] == {"type": "coil", "inner_diameter": "0.5 mm"} and got["products"] == [{"name": None, "yield_optimal": 82, "unit": "%"}]
    assert got["metrics"] == {"conversion": None, "yield": 82, "selectivity": None, "unit": "%"}
    assert backends.same_micro("5 μm") == "5 µm"


def test_backend_resolution(monkeypatch):
    backends.register("classify", "/models/own", lambda: None)
    assert backends.resolve("classify", "own", "/models")() is None
    assert backends.resolve("classify", "absent") is backends.resolve("classify", "rules")
    with pytest.raises(LookupError):
        backends.resolve("classify", "absent", strict=True)
    monkeypatch.setenv("PAPERLOOM_STRICT_MODEL", "rules")
    assert backends.resolve("classify", "", strict=True) is backends.resolve("classify", "rules")


def test_metrics(spark):
    docs = spark.createDataFrame([("a", "x\n\ny z"), ("b", ""), ("c", None)], "doc_id string, text string")
    rows = paragraphs(docs)
    stats = {r.doc_id: tuple(r)[1:] for r in metrics.segmentation_stats(docs).collect()}
    assert stats == {"a": (3, 1, 2, 2.0), "b": (1, 1, 0, None), "c": (1, 1, 0, None)}
    sizes = {r.doc_id: r for r in metrics.stage_metrics(docs, {"raw": rows, "kept": rows.filter("pos = 0")}).collect()}
    assert (sizes["a"].raw_lines, sizes["a"].raw_bytes, sizes["a"].kept_bytes, sizes["b"].raw_bytes) == (4, 8, 3, 0)
    kept = {r.doc_id: (r.n_before, r.n_after, r.percent) for r in metrics.retention(rows, rows.filter("pos = 0")).collect()}
    assert kept == {"a": (2, 1, 50.0), None: (2, 1, 50.0)}
    assert {r.doc_id: r.n_rows for r in metrics.row_counts(rows).collect()} == {"a": 2}


def test_text_round_trip(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.txt").write_bytes(b"a\nb\n\nc \xff d\n")
    docs = read_text(spark, str(source))
    rows = paragraphs(docs)
    assert [(r.doc_id, r.pos, r.content) for r in rows.orderBy("pos").collect()] == [("one", 0, "a b"), ("one", 1, "c  d")]
    assert document_texts(rows).first().text == "a b\n\nc  d\n\n"
    write_text(rows, str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out" / "doc_id=one").glob("*.txt")] == ["a b\n\nc  d\n\n"]
    write_sections(rows.withColumn("section", F.lit("other")), str(tmp_path / "sections"))
    assert (tmp_path / "sections" / "doc_id=one" / "section=other").exists()


def test_output_names(spark):
    names = lambda path, stage: spark.range(1).select(output_name(F.lit(path), stage)).first()[0]
    assert names("d/x.txt", "processed") == "d/Processed_x.txt" and names("d/Processed_x.txt", "embedded") == "d/Embedding_x.txt"
    assert names("a.txt/b.txt", "filtered") == "a_Filtered.txt/b_Filtered.txt"


def test_remaining(spark):
    inputs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert [r.doc_id for r in remaining(inputs, inputs.limit(1)).collect()] == ["b"]


def test_pdf_pages_with_own_decoder(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"one\f \ftwo")
    pages = read_pdf_pages(spark, str(tmp_path), lambda raw: raw.decode().split("\f"))
    assert [(r.doc_id, r.page_no, r.text) for r in pages.orderBy("page_no").collect()] == [("p", 0, "one"), ("p", 2, "two")]


def test_html_and_tables(spark):
    html = spark.createDataFrame([(1, "<style>x</style><p>a &lt;b&gt;&amp;amp;</p><!-- n --><script>s</script>"), (2, None)], "page_id int, html string")
    assert {r.page_id: r.text for r in html_to_text(html).collect()} == {1: "a <b>&amp;", 2: ""}
    text = "t\r\n| A | B |\r\n|---|:-:|\r\n| x | y |\r\n| z |\r\n\r\n| A | B |\r\n|---|---|\r\n| Precursor 1 | N/A |"
    got = [(r.table_no, r.row_no, r.precursor, r.substrate) for r in markdown_tables(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("table_no", "row_no").collect()]
    assert got == [(1, 1, "x", "y"), (1, 2, "z", None), (2, 1, "Precursor 1", "N/A")]


def test_pipeline_modes_and_stream(spark, tmp_path):
    text = "A flow reactor at 80 °C gave a yield of 82%.\n\nNothing here.\n\nAcknowledgements\n\nafter"
    docs = spark.createDataFrame([("d", text), ("empty", "")], "doc_id string, text string")
    pipeline = Pipeline(replace(Config(), top_n=2))
    stages = pipeline.process(docs)
    assert stages["processed"].count() == 3 and stages["embedded"].count() == 2
    overall = stages["overall"].first()
    assert overall.doc_id == "d" and overall.summary.metrics["yield"] == 82.0
    sizes, kept = pipeline.report(docs, stages)
    assert sizes.count() == 2 and kept.filter("doc_id IS NULL").count() == 1
    with pytest.raises(ValueError):
        pipeline.process(docs, "other")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.txt").write_text(text)
    run_stream(read_text_stream(spark, str(tmp_path / "in")), pipeline, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["d"]


def test_environment_config(monkeypatch):
    monkeypatch.setenv("PAPERLOOM_TOP_N", "20")
    assert Config.from_environment().top_n == 20 and Config.from_environment(top_n=5).top_n == 5


def test_each_model_is_asked_once_a_row(spark, tmp_path):
    """Every call of a backend leaves the rows it was given, by stage."""
    from paperloom.plans.pipeline import Pipeline

    def counting(stage, name):
        inner = backends.resolve(stage, "rules")

        def factory():
            import uuid

            answer = inner()

            def ask(prompts, contents, n):
                (tmp_path / f"{name}-{uuid.uuid4().hex}").write_text(str(len(contents)))
                return answer(prompts, contents, n)

            return ask

        return factory

    pipeline = Pipeline()
    pipeline._backends = {s: counting(s, s) for s in pipeline._backends}
    docs = spark.createDataFrame([(f"d{i}", f"plain text {i}.\n\nflow of {i} in words") for i in range(10)], "doc_id string, text string")
    stages = pipeline.process(docs)
    stages["overall"].collect()
    asked = {}
    for file in tmp_path.iterdir():
        stage = file.name.split("-")[0]
        asked[stage] = asked.get(stage, 0) + int(file.read_text())
    assert asked["classify"] <= 20 and asked["abstract"] == 20 and asked["overall"] == 10 and "summary" not in asked


def test_fallback_in_one_pass(spark):
    rows = rows_of(spark, {"a": ["x", "y"], "b": ["y", "y"]}).withColumn("classification", F.when(F.col("content") == "x", "Yes").otherwise("No"))
    assert sorted((r.doc_id, r.pos) for r in models.relevant_or_all(rows).collect()) == [("a", 0), ("b", 0), ("b", 1)]


def test_warm_up_only_warns():
    def broken():
        raise OSError("no model")

    assert models.warm_up(backends.resolve("abstract", "rules")) is None
    with pytest.warns(UserWarning, match="no model"):
        assert models.warm_up(broken) == "no model"


def test_page_blocks(spark):
    from paperloom.plans.pipeline import Pipeline

    pages = spark.createDataFrame([("d", 1, " a\nb \n\n\n\nc\n\n "), ("d", 2, None), ("d", 3, "e\n\n\nf")], "doc_id string, page_no int, text string")
    got = [(r.page_no, r.pos, r.content) for r in Pipeline().page_paragraphs(pages).orderBy("page_no", "pos").collect()]
    assert got == [(1, 0, "a\nb"), (1, 1, "c"), (3, 0, "e"), (3, 1, "f")]


def test_values_are_bound_once(spark):
    """A text is split into terms and a document cut into paragraphs once a row, however often they are used."""
    from paperloom.functions.text import segments
    from paperloom.operators.clean import truncated
    from paperloom.operators.similarity import term_similarity

    docs = spark.createDataFrame([("a b a\n\nreferences",)], "text string")
    plan = lambda c: docs.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(term_similarity(F.col("text"), "a b c d")).count("regexp_extract_all") == 1
    assert plan(truncated(segments(F.col("text")))).count("split(") == 1


def test_rules_read_long_runs_of_digits_once():
    """A pattern that begins at every digit takes the square of a run's length."""
    from paperloom.operators.backends import extracted, has_fact

    begun = time.process_time()
    found = extracted("7" * 60_000 + " and 3.5 K, a residence time of 4 min, yield of -2.5%, 1.2.3 bar in a Coil")["reaction_summary"]
    assert not has_fact("7" * 60_000) and time.process_time() - begun < 2
    assert found["conditions"] == [{"type": "temperature", "value": "3.5 K"}, {"type": "residence_time", "value": "4 min"}, {"type": "pressure", "value": "2.3 bar"}]
    assert found["metrics"]["yield"] == -2.5 and found["reactor"]["type"] == "coil"


def test_paragraphs_of_long_blank_runs_take_linear_time(spark):
    """Blanks that no line break follows are passed over once, not from each of them on."""
    from paperloom.functions.text import segments

    text = "a" + " " * 100_000 + "b\n \x1c \n c\nd \r\n\r\n\x1c\n\n z"
    begun = time.time()
    assert spark.createDataFrame([(text,)], "t string").select(segments(F.col("t"))).first()[0] == ["a" + " " * 100_000 + "b \x1c c d", "\x1c", "z"]
    assert time.time() - begun < 8


def test_several_references_split_and_sort_a_text_once(spark, capsys):
    from paperloom.operators.similarity import term_similarities, term_similarity

    rows = spark.createDataFrame([("the the cat",), ("",), (None,), ("A b",)], "t string")
    one = [tuple(r) for r in rows.select(term_similarity(F.col("t"), "the cat"), term_similarity(F.col("t"), "a"), term_similarity(F.col("t"), "")).collect()]
    both = rows.select(term_similarities(F.col("t"), ("the cat", "a", "")).alias("s"))
    assert [tuple(r.s) for r in both.collect()] == one
    both.explain()
    assert capsys.readouterr().out.count("sort_array(") == 1
