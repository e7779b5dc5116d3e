import pickle
from unittest.mock import patch

import pytest
from pyspark.sql import functions as F

from paperloom.sources.files import FileSink, checked_name, json_files, priority_files, read_files, section_files, text_files, write_files


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, pos int, section string, content string")


ROWS = [("d", 1, "abstract", "second"), ("d", 0, "abstract", "first é"), ("d", 2, "results", "r"), ("d", 3, "conclusion", "c"), ("d", 4, "other", " "), ("e", 0, "other", "only"), ("f", 0, "other", None)]


def test_bytes_are_exact(spark, tmp_path):
    rows, path = rows_of(spark, ROWS).repartition(4), str(tmp_path / "out")
    write_files(text_files(rows), path)
    write_files(section_files(rows), path)
    write_files(priority_files(rows), path, ("part", "pos"))
    write_files(json_files(spark.createDataFrame([("d", '{"a": 1}'), ("e", None)], "doc_id string, overall string")), path)
    found = {str(p.relative_to(path)): p.read_bytes().decode() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {
        "d/d.txt": "first é\n\nsecond\n\nr\n\nc\n\n \n\n", "e/e.txt": "only\n\n", "f/f.txt": "\n\n",
        "d/d_abstract.txt": "first é\n\nsecond\n\n", "d/d_results.txt": "r\n\n", "d/d_conclusion.txt": "c\n\n", "e/e_other.txt": "only\n\n",
        "d/d_priority.txt": "first é\n\nsecond\n\nc\n\nr\n\n", "d/d_Overall.txt": '{"a": 1}', "e/e_Overall.txt": "",
    }


def test_files_are_replaced_and_empty_tables_write_none(spark, tmp_path):
    path = str(tmp_path / "out")
    write_files(text_files(rows_of(spark, ROWS[:1])), path)
    write_files(text_files(rows_of(spark, [("d", 0, "x", "new")])), path)
    assert (tmp_path / "out" / "d" / "d.txt").read_text() == "new\n\n"
    write_files(text_files(rows_of(spark, [])), str(tmp_path / "none"))
    assert not [p for p in (tmp_path / "none").rglob("*")]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    write_files(text_files(rows_of(spark, ROWS[:1])), path)
    bad = text_files(rows_of(spark, ROWS)).withColumn("value", F.when(F.col("pos") == 3, F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        write_files(bad, path)
    assert [str(p.relative_to(path)) for p in (tmp_path / "out").rglob("*") if p.is_file()] == ["d/d.txt"]
    assert (tmp_path / "out" / "d" / "d.txt").read_text() == "second\n\n" and not list((tmp_path / "out").glob("_staging*"))


def test_names_stay_below_the_root(spark, tmp_path):
    assert checked_name("a/b.txt") == "a/b.txt"
    for name in ("../a", "/a", "", None, "a/../../b", "."):
        with pytest.raises(ValueError):
            checked_name(name)
    with pytest.raises(Exception, match="not a file name"):
        write_files(text_files(rows_of(spark, [("..", 0, "x", "y")])), str(tmp_path / "out" / "in"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_names_of_files_do_not_pass_through_the_driver(spark, tmp_path):
    path, listing = str(tmp_path / "out"), str(tmp_path / "listing")
    rows = text_files(spark.range(300).selectExpr("id AS doc_id", "0 AS pos", "concat('text ', id) AS content"))
    write_files(rows, path, listing=listing)
    names = spark.read.schema("file string").parquet(listing)
    found = read_files(names, path)
    assert {r.file: (r.n_bytes, bytes(r.content).decode()) for r in found.collect()} == {f"{i}/{i}.txt": (len(f"text {i}\n\n"), f"text {i}\n\n") for i in range(300)}
    # what a task tells the driver is one name, however many files it wrote
    writer = FileSink({"path": str(tmp_path / "staging")}).writer(rows.select("file", "value").schema, False)
    with patch("paperloom.sources.files.TaskContext") as task:
        task.get.return_value.taskAttemptId.return_value = 7
        told = [writer.write(iter([(f"{i}/{i}.txt", "x") for i in range(n)])) for n in (1, 500)]
    assert len(pickle.dumps(told[0])) == len(pickle.dumps(told[1]))
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
