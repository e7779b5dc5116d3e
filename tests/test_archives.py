import zipfile
from pathlib import Path
from unittest.mock import patch

import pytest
from pyspark.sql import functions as F

from paperloom.operators.pages import page_sections, process_pages
from paperloom.plans.catalogue import KEYWORDS, QUERIES, _pages
from paperloom.sources.archives import read_archives, write_archives
from paperloom.sources.files import FileSink, output_files, text_files


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "file string, pos int, value string")


ROWS = [("d/b.txt", 1, "zweite"), ("d/b.txt", 0, "first é\n"), ("d/a.txt", 0, None), ("e/ü.txt", 0, "x" * 5000), ("e/ü.txt", 1, "\r\n"), ("f", 0, "")]
FILES = {"d/b.txt": "first é\nzweite", "d/a.txt": "", "e/ü.txt": "x" * 5000 + "\r\n", "f": ""}


def found_in(spark, path):
    rows = read_archives(spark, path).collect()
    assert all(r.n_bytes == len(r.content) for r in rows)
    found = {r.file: bytes(r.content).decode() for r in rows}
    assert len(found) == len(rows)
    return found


def test_bytes_are_exact_and_other_tools_read_them(spark, tmp_path):
    path = str(tmp_path / "out")
    write_archives(rows_of(spark, ROWS).repartition(3), path)
    assert found_in(spark, path) == FILES
    members = {}
    for place in (tmp_path / "out").iterdir():
        with zipfile.ZipFile(place) as archive:
            assert archive.testzip() is None
            members |= {name: archive.read(name).decode() for name in archive.namelist()}
    assert members == FILES


@pytest.mark.parametrize("bounds", [{"files": 7}, {"size": 200}])
def test_archives_are_bounded_and_hold_whole_files(spark, tmp_path, bounds):
    path = str(tmp_path / "out")
    rows = text_files(spark.range(100).selectExpr("id AS doc_id", "explode(sequence(0, 2)) AS pos").selectExpr("doc_id", "pos", "concat('text ', doc_id, ' ', pos) AS content"))
    write_archives(rows.coalesce(1), path, dealt=True, **bounds)
    assert len(list((tmp_path / "out").iterdir())) >= 14
    assert found_in(spark, path) == {f"{i}/{i}.txt": "".join(f"text {i} {k}\n\n" for k in range(3)) for i in range(100)}


def test_empty_tables_failed_tasks_and_names(spark, tmp_path):
    write_archives(rows_of(spark, []), str(tmp_path / "none"))
    assert read_archives(spark, str(tmp_path / "none")).count() == 0
    bad = rows_of(spark, ROWS).withColumn("value", F.when(F.col("file") == "e/ü.txt", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        write_archives(bad, str(tmp_path / "bad"))
    for name in ("../a", "/a", "a//b", "", "a\0b", None):
        with pytest.raises(Exception, match="not a file name"):
            write_archives(rows_of(spark, [(name, 0, "x")]), str(tmp_path / "bad"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    write_archives(rows_of(spark, ROWS), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="holds archives"):
        write_archives(rows_of(spark, ROWS), str(tmp_path / "out"))
    assert found_in(spark, str(tmp_path / "out")) == FILES


def test_written_files_take_no_more_disk_than_their_bytes(spark, sf):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.glob("*")) if shared.exists() else set()
    n_bytes = QUERIES["written_files"](spark, sf).agg(F.sum("n_bytes")).first()[0]
    places = [p for top in set(shared.glob("*")) - before for p in (top, *top.rglob("*"))]
    assert sum(p.lstat().st_blocks * 512 for p in places) < n_bytes
    assert len(places) < 50  # and few entries of the file system: 200 documents have some 450 files


def test_outputs_of_a_document_come_in_one_partition(spark, sf):
    pages = _pages(spark, sf)
    rows = [process_pages(pages, mode, KEYWORDS, dealt=dealt) for mode in ("basic", "structured", "comprehensive") for dealt in (False, True)]
    for plain, dealt in zip(rows[::2], rows[1::2], strict=True):
        assert sorted(plain.collect()) == sorted(dealt.collect())
        placed = output_files(dealt).withColumn("at", F.spark_partition_id())
        assert placed.groupBy("file").agg(F.count_distinct("at").alias("n")).filter("n > 1").count() == 0


def test_runs_of_a_document_are_dealt_by_one_shuffle(spark, sf):
    plain, dealt = (page_sections(_pages(spark, sf), KEYWORDS, run_pages=2, dealt=d).drop("text") for d in (False, True))
    assert sorted(plain.collect()) == sorted(dealt.collect())
    assert dealt.withColumn("at", F.spark_partition_id()).groupBy("doc_id").agg(F.count_distinct("at").alias("n")).filter("n > 1").count() == 0
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in (plain, dealt)]
    assert plans[0].count("Exchange ") == plans[1].count("Exchange ") > 0


def test_staged_files_have_no_folder_each(tmp_path):
    writer = FileSink({"path": str(tmp_path)}).writer(type("Schema", (), {"fieldNames": lambda self: ["file", "value"]})(), False)
    with patch("paperloom.sources.files.TaskContext") as task:
        task.get.return_value.taskAttemptId.return_value = 7
        writer.write(iter([(f"{i}/{i}.txt", "x") for i in range(20)]))
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_dir()) == ["7", "listed"]
