"""Model operators: classify, abstract, summarize, merge.

Each is an iterator pandas UDF: its backend is made once a task and gets whole batches. Failures
of a model are data in a column ``error``, not exceptions; ``compatible`` gives the text form.
Rows are limited before a model column is added, and a row that is not to be asked has a null prompt,
since Spark does not skip a Python function inside a CASE.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.json import longest_block, outer_braces, repaired, strip_markdown
from ..functions.text import contains_any, not_blank, or_empty, starts_yes, strip
from .backends import Backend

MODEL_ANSWER = "struct<answer: string, error: string>"
#: Adds ``_model`` to rows from (rows, factory, prompts, contents, max_tokens).
Ask = Callable[[DataFrame, Callable[[], Backend], Column, Column, int], DataFrame]


def prompt(system: str, context: Column, task: str) -> Column:
    return F.concat(F.lit(f"{system}\n\n### Paragraph to Analyze ###\n"), or_empty(context), F.lit(f"\n\n### Task ###\n{task}"))


def model_column(factory: Callable[[], Backend], prompts: Column, contents: Column, max_tokens: int) -> Column:
    """A struct (answer, error) of the model's answers; a row with a null prompt is not asked. A batch
    that fails is asked row by row, so an error stays with its row.

    The function counts as not deterministic, so the plan neither copies it to where its fields
    are used nor evaluates it again in a filter: each row is asked once.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        backend = factory()
        for prompts_, texts in batches:
            answers, errors = [None] * len(prompts_), [None] * len(prompts_)
            rows = [(i, one, text) for i, (one, text) in enumerate(zip(prompts_.tolist(), texts.tolist(), strict=True)) if one is not None]
            try:
                found = list(backend([one for _, one, _ in rows], [text for _, _, text in rows], max_tokens)) if rows else []
                for (i, _, _), answer in zip(rows, found, strict=True):
                    answers[i] = answer
            except Exception:
                for i, one, text in rows:
                    try:
                        answers[i] = backend([one], [text], max_tokens)[0]
                    except Exception as e:
                        errors[i] = str(e)
            yield pd.DataFrame({"answer": answers, "error": errors}, dtype=object)

    return F.pandas_udf(run, MODEL_ANSWER).asNondeterministic()(prompts, contents)


def asked(rows: DataFrame, factory: Callable[[], Backend], prompts: Column, contents: Column, max_tokens: int) -> DataFrame:
    """Adds ``_model``: each row is asked. A store of answers (``operators.answers``) has the same form."""
    return rows.withColumn("_model", model_column(factory, prompts, contents, max_tokens))


def warm_up(factory: Callable[[], Backend], max_tokens: int = 8) -> str | None:
    """Ask a backend once, on the driver. A failure is a warning, and its text is returned."""
    try:
        factory()(["Ready?"], ["Ready?"], max_tokens)
    except Exception as e:
        warnings.warn(f"warm-up failed: {e}", stacklevel=2)
        return str(e)
    return None


def keyword_gate(rows: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Adds ``gated``: whether the content holds a keyword as a plain substring."""
    return rows.withColumn("gated", contains_any(or_empty(F.col("content")), keywords))


def classify(rows: DataFrame, factory: Callable[[], Backend], config: Config = Config(), ask: Ask = asked) -> DataFrame:
    """Adds ``classification`` ('Yes' or 'No'). Rows with a keyword are 'Yes' and never reach the
    model: their prompt is null. An empty answer or an error is 'No'."""
    gated = keyword_gate(rows, config.gate_keywords)
    prompts = F.when(~F.col("gated"), prompt(config.system_prompt, F.col("content"), config.classify_task))
    out = ask(gated, factory, prompts, or_empty(F.col("content")), 5)
    return out.withColumn("classification", F.when(F.col("gated") | starts_yes(F.col("_model.answer")), "Yes").otherwise("No")).drop("_model", "gated")


def relevant(rows: DataFrame, factory: Callable[[], Backend], config: Config = Config(), ask: Ask = asked) -> DataFrame:
    return classify(rows, factory, config, ask).filter("classification = 'Yes'")


def relevant_or_all(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows with classification 'Yes', and all rows of the documents without any, from one pass
    over the classified rows (a document has at most the top N of them)."""
    some = F.max(F.col("classification") == "Yes").over(Window.partitionBy(key))
    return classified.withColumn("_some", some).filter("classification = 'Yes' OR NOT _some").drop("_some")


def abstracts(rows: DataFrame, factory: Callable[[], Backend], config: Config = Config(), ask: Ask = asked) -> DataFrame:
    """Adds ``abstract`` and ``error``: an empty answer gives the first characters of the content."""
    out = ask(rows, factory, prompt(config.system_prompt, F.col("content"), config.abstract_task), or_empty(F.col("content")), 300)
    text = strip(or_empty(F.col("_model.answer")))
    short = F.left(or_empty(F.col("content")), F.lit(config.abstract_chars))
    return out.withColumn("abstract", F.when(F.col("_model.error").isNull(), F.when(text == "", short).otherwise(text))).withColumn("error", F.col("_model.error")).drop("_model")


def summaries(rows: DataFrame, factory: Callable[[], Backend], config: Config = Config(), input_col: str = "abstract", ask: Ask = asked) -> DataFrame:
    """Adds ``summarized`` (from the first to the last brace of the answer) and ``error``."""
    out = ask(rows.drop("error"), factory, prompt(config.system_prompt, F.col(input_col), config.summary_task), or_empty(F.col(input_col)), 300)
    text = outer_braces(strip(or_empty(F.col("_model.answer"))))
    return out.withColumn("summarized", F.when(F.col("_model.error").isNull(), text)).withColumn("error", F.col("_model.error")).drop("_model")


def compatible(column: str) -> Column:
    """A model column in text form, with errors as ``Error: ...``."""
    return F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error"))).otherwise(F.col(column))


def document_concat(rows: DataFrame, column: str, limit: int = 12_000, order: tuple[str, ...] = ("pos",), key: str = "doc_id") -> DataFrame:
    """(doc_id, combined): the non-blank texts in order, a blank line between, cut at ``limit``.

    Rows that start beyond the limit are dropped before they are gathered, so a group holds no
    more than the limit and one text.
    """
    kept = rows.filter(not_blank(F.col(column)))
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("_at", F.coalesce(F.sum(F.char_length(column) + 2).over(before), F.lit(0))).filter(F.col("_at") < limit)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(column).alias("text")))), lambda r: r["text"])
    return kept.groupBy(key).agg(F.left(F.array_join(texts, "\n\n"), F.lit(limit)).alias("combined"))


def document_summaries(rows: DataFrame, factory: Callable[[], Backend], config: Config = Config(), column: str = "abstract", order: tuple[str, ...] = ("rank",), ask: Ask = asked) -> DataFrame:
    """(doc_id, overall, error): one JSON a document, from its texts joined in order, cleaned by
    the markdown, brace and JSON rules."""
    joined = document_concat(rows, column, config.overall_chars, order)
    out = ask(joined, factory, prompt(config.system_prompt, F.col("combined"), config.overall_task), F.col("combined"), 1200)
    raw = strip_markdown(F.col("_model.answer"))
    return out.select("doc_id", F.when(F.col("_model.error").isNull(), repaired(longest_block(raw))).alias("overall"), F.col("_model.error").alias("error"))
