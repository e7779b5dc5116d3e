"""Runs of named stages: written once, measured while they are written, published one by one, and
deleted when nothing needs them any more.

A stage's rows go to a folder of their own; then the manifest, a small JSON file, is replaced by one
that names it. A run that fails is called again with the same path and goes on from the last stage
published; what a dead attempt wrote without publishing is swept. Each stage counts its readers: when
the last of them is published and the stage is not a result, its folder goes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import or_empty

StageFunction = Callable[..., DataFrame]


@dataclass(frozen=True)
class Stage:
    """name, the stages that it reads, and a function of their rows. ``column``: the text that is
    measured, if any."""

    name: str
    inputs: tuple[str, ...]
    function: StageFunction
    column: str | None = "content"


class Folder:
    """A folder that all executors see, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def names(self) -> list[str]:
        files, place = self._place("")
        return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []

    def delete(self, name: str) -> None:
        files, place = self._place(name)
        files.delete(place, True)

    def read(self, name: str) -> str | None:
        files, place = self._place(name)
        if not files.exists(place):
            return None
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def replace(self, name: str, text: str) -> None:
        """A reader finds the file as it was or as it is now: it is written aside and renamed."""
        aside = f"_{name}-{uuid.uuid4().hex}"
        files, place = self._place(aside)
        out = files.create(place, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        _, target = self._place(name)
        options = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else files.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        overwrite = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = overwrite
        options.rename(place, target, array)


def measures(rows: DataFrame, column: str | None) -> list:
    """What is counted of a stage while it is written: rows, and lines and bytes as the text sink
    would write them (each row and a blank line)."""
    out = [F.count(F.lit(1)).alias("n_rows")]
    if column in rows.columns:
        out += [(2 * F.count(F.lit(1))).alias("n_lines"), F.coalesce(F.sum(F.octet_length(or_empty(F.col(column))) + 2), F.lit(0)).cast("long").alias("n_bytes")]
    return out


class Run:
    """A run under ``path``. ``results`` names the stages that stay; by default those that no other
    stage reads."""

    MANIFEST = "manifest.json"

    def __init__(self, spark: SparkSession, path: str, stages: Iterable[Stage], results: Iterable[str] | None = None):
        self.spark, self.folder, self.stages = spark, Folder(spark, path), list(stages)
        names = [s.name for s in self.stages]
        read = {i for s in self.stages for i in s.inputs}
        if len(set(names)) < len(names):
            raise ValueError("two stages have one name")
        self.results = set(results) if results is not None else set(names) - read
        if self.results - set(names):
            raise ValueError(f"no such stage: {sorted(self.results - set(names))}")

    def manifest(self) -> dict:
        text = self.folder.read(self.MANIFEST)
        return json.loads(text) if text else {"stages": {}}

    def table(self, name: str) -> DataFrame:
        entry = self.manifest()["stages"][name]
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.folder.path}/{entry['folder']}")

    def metrics(self) -> dict[str, dict[str, int]]:
        """What was counted of each stage, those deleted since included."""
        return {name: entry["metrics"] for name, entry in self.manifest()["stages"].items()}

    def go(self, **sources: DataFrame) -> dict[str, DataFrame]:
        """Write the stages that are not published yet, in order, and return the results. ``sources``
        are the rows that come from outside, by the name under which stages read them."""
        state = self.manifest()
        self._sweep(state)
        left = self._to_write(state["stages"])
        for stage in [s for s in self.stages if s.name in left]:
            inputs = [sources[n] if n in sources else self.table(n) for n in stage.inputs]
            state["stages"][stage.name] = self._written(stage, stage.function(*inputs))
            self.folder.replace(self.MANIFEST, json.dumps(state))
            left.remove(stage.name)
            self._release(state, left)
        return {name: self.table(name) for name in sorted(self.results)}

    def _to_write(self, done: dict) -> set[str]:
        """The results that are not there, and what they are made from as far as it is not there."""
        inputs = {s.name: s.inputs for s in self.stages}
        left: set[str] = set()
        open_ = list(self.results)
        while open_:
            name = open_.pop()
            if name in inputs and name not in left and not done.get(name, {}).get("folder"):
                left.add(name)
                open_ += inputs[name]
        return left

    def _written(self, stage: Stage, rows: DataFrame) -> dict:
        seen = Observation(f"{stage.name}-{uuid.uuid4().hex}")
        folder = f"{stage.name}-{uuid.uuid4().hex}"
        rows.observe(seen, *measures(rows, stage.column)).write.parquet(f"{self.folder.path}/{folder}")
        return {"folder": folder, "schema": rows.schema.json(), "metrics": {k: int(v) for k, v in seen.get.items()}}

    def _release(self, state: dict, left: set[str]) -> None:
        """Delete the folders of the stages that no stage still to be written reads."""
        done = state["stages"]
        read = {n for s in self.stages if s.name in left for n in s.inputs}
        for name in [n for n, e in done.items() if e["folder"] and n not in self.results and n not in read]:
            folder, done[name]["folder"] = done[name]["folder"], ""
            self.folder.replace(self.MANIFEST, json.dumps(state))  # first forgotten, then deleted
            self.folder.delete(folder)

    def _sweep(self, state: dict) -> None:
        """Delete what attempts wrote and did not publish."""
        kept = {e["folder"] for e in state["stages"].values()} | {self.MANIFEST}
        for name in self.folder.names():
            if name not in kept and not name.startswith(f".{self.MANIFEST}"):
                self.folder.delete(name)
