"""The five stages as one lazy plan.

sources -> paragraphs -> back matter -> top N by similarity -> gate and classifier -> abstracts
-> summaries -> one JSON a document. Stages pass DataFrames on; nothing runs until a result is
asked for, and every stage but the last keeps (doc_id, pos).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.json import parsed_summary
from ..functions.text import page_blocks, segments
from ..operators import backends, embedders, models
from ..operators.answers import AnswerStore
from ..operators.clean import truncated
from ..operators.metrics import retention, stage_metrics
from ..operators.pages import process_pages
from ..operators.sections import assign_sections, priority_content
from ..operators.segment import pack_chunks
from ..operators.similarity import embed_and_compare, top_by_group, top_by_references
from .runs import Run, Stage

MODES = ("filter", "abstract", "summarize", "comprehensive")


class Pipeline:
    """The stages with one configuration. ``process`` runs a mode and returns its DataFrames."""

    def __init__(self, config: Config | None = None, store: AnswerStore | None = None):
        """With a store, answers are kept in it and no prompt is asked twice; stages then run when
        they are called for, as each asks what the store lacks."""
        self.config, self.store = config or Config.from_environment(), store
        self._embedder = embedders.resolve(self.config.backends["embed"], self.config.strict)
        self._backends = {s: backends.resolve(s, self.config.backends[s], self.config.model_dir, self.config.strict) for s in ("classify", "abstract", "summary", "overall")}

    def _ask(self, stage: str) -> models.Ask:
        return self.store.under(f"{stage}/{self.config.backends[stage]}") if self.store else models.asked

    def warm_up(self) -> dict[str, str]:
        """Ask each backend once; the failures by stage, which are warnings only."""
        return {s: error for s, factory in self._backends.items() if (error := models.warm_up(factory))}

    def process_pages(self, pages: DataFrame, mode: str = "comprehensive") -> DataFrame:
        """The outputs of paged documents (doc_id, page_no, text) in one of the modes ``basic``,
        ``structured`` and ``comprehensive``; see ``operators.pages``."""
        c = self.config
        return process_pages(pages, mode, c.section_keywords, c.sections, c.title_chars, c.priority, c.max_tokens)

    def page_paragraphs(self, pages: DataFrame) -> DataFrame:
        """Blocks of pages (doc_id, page_no, text) as rows (doc_id, page_no, pos, content)."""
        return pages.select("doc_id", "page_no", F.posexplode(page_blocks(F.col("text"))).alias("pos", "content"))

    def chunks(self, pages: DataFrame) -> DataFrame:
        """Pages (doc_id, page_no, text) as packed chunks."""
        return pack_chunks(pages, self.config.max_tokens)

    def sections(self, rows: DataFrame) -> DataFrame:
        c = self.config
        return assign_sections(rows, c.section_keywords, c.sections, c.title_chars)

    def priority(self, rows: DataFrame) -> DataFrame:
        return priority_content(self.sections(rows), self.config.priority)

    def preprocess(self, docs: DataFrame) -> DataFrame:
        """Paragraphs of whole texts up to the back matter: row by row, before any shuffle."""
        kept = truncated(segments(F.col("text")), self.config.back_matter)
        return docs.select("doc_id", F.posexplode(kept).alias("pos", "content"))

    def top(self, rows: DataFrame) -> DataFrame:
        compared = embed_and_compare(rows, self.config.embedding_reference, embedder=self._embedder)
        return top_by_group(compared.drop("content_embedding"), self.config.top_n)

    def top_by_references(self, rows: DataFrame) -> DataFrame:
        """The top N rows of each document for both references, of the experiment and of abstracts and
        conclusions, with ``reference`` and ``rank``, in one pass."""
        named = {"experiment": self.config.embedding_reference, "abstract": self.config.abstract_reference}
        for name, text in named.items():
            compared = embed_and_compare(rows, text, embedder=self._embedder).drop("content_embedding")
            rows = compared.withColumnRenamed("similarity", f"_{name}")
        return top_by_references(rows, {name: F.col(f"_{name}") for name in named}, self.config.top_n).drop(*[f"_{name}" for name in named])

    def filter(self, rows: DataFrame) -> DataFrame:
        return models.relevant(rows, self._backends["classify"], self.config, self._ask("classify"))

    def abstract(self, rows: DataFrame) -> DataFrame:
        return models.abstracts(rows, self._backends["abstract"], self.config, self._ask("abstract"))

    def summarize(self, rows: DataFrame, input_col: str = "abstract") -> DataFrame:
        return models.summaries(rows, self._backends["summary"], self.config, input_col, self._ask("summary"))

    def overall(self, rows: DataFrame, column: str = "abstract") -> DataFrame:
        """One row a document with ``overall`` (JSON text) and ``summary`` (typed)."""
        found = models.document_summaries(rows, self._backends["overall"], self.config, column, ("rank",), self._ask("overall"))
        return found.withColumn("summary", parsed_summary(F.col("overall")))

    def process(self, docs: DataFrame, mode: str = "comprehensive") -> dict[str, DataFrame]:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        out = {"processed": self.preprocess(docs)}
        out["embedded"] = self.top(out["processed"])
        out["filtered"] = models.relevant_or_all(models.classify(out["embedded"], self._backends["classify"], self.config, self._ask("classify")))
        if mode != "filter":
            out["abstract"] = self.abstract(out["filtered"])
        if mode in ("summarize", "comprehensive"):
            out["summarized"] = self.summarize(out["abstract"])
            out["overall"] = self.overall(out["abstract"])
        return out

    def run(self, docs: DataFrame, path: str, mode: str = "comprehensive", keep: tuple[str, ...] = ("summarized", "overall")) -> Run:
        """Run a mode stage by stage under ``path`` and return the run, with its results and the counts
        of every stage. Only ``keep`` stays; calling it again goes on where a run was broken off."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        classify = lambda rows: models.relevant_or_all(models.classify(rows, self._backends["classify"], self.config, self._ask("classify")))
        stages = [Stage("processed", ("documents",), self.preprocess), Stage("embedded", ("processed",), self.top), Stage("filtered", ("embedded",), classify)]
        if mode != "filter":
            stages.append(Stage("abstract", ("filtered",), self.abstract, "abstract"))
        if mode in ("summarize", "comprehensive"):
            stages += [Stage("summarized", ("abstract",), self.summarize, "summarized"), Stage("overall", ("abstract",), self.overall, "overall")]
        kept = [s.name for s in stages if s.name in keep] or [stages[-1].name]
        run = Run(docs.sparkSession, path, stages, kept)
        run.go(documents=docs)
        return run

    def report(self, docs: DataFrame, stages: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Stage sizes a document, and the share of the processed rows that the filter kept."""
        rows = {k: v for k, v in stages.items() if k in ("processed", "embedded", "filtered")}
        return stage_metrics(docs.select("doc_id"), rows), retention(stages["processed"], stages["filtered"])
