"""Similarity to a reference, and the most similar rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .embedders import Embedder, embedded, register

TOKEN = r"[A-Za-z0-9]+"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def _buckets(text: Column, width: int) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast("int"))


def hashed_embedding(text: Column, width: int = 64) -> Column:
    """A fixed-width count vector of hashed lower-case tokens: the deterministic stand-in for a
    sentence model. The token buckets are bound by an outer lambda, so a text is split once."""

    def counts(bound: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(bound, lambda x: x == i)).cast("float"))

    return bound(_buckets(text, width), counts)


def squared_counts(items: Column, none: Column) -> Column:
    """Sum of the squared counts of an array's distinct items, by one fold over the sorted array:
    the m-th equal item adds 2 * m - 1. ``none`` is a value of the items' type."""
    start = F.struct(none.alias("item"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["item"] == x, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("item"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total"))

    # sort_array has the items' own order; array_sort calls an expression for each comparison
    return F.aggregate(F.sort_array(items), start, step, lambda acc: acc["total"])


def hashed_similarity(text: Column, reference: Column, width: int = 64) -> Column:
    """Cosine of a text's hashed embedding to a reference vector, in one pass over its tokens: the
    dense vector is not made."""

    def similarity(buckets: Column) -> Column:
        product = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(reference, b).cast("double"))
        norm = F.sqrt(squared_counts(buckets, F.lit(-1)).cast("double")) * F.sqrt(dot(reference, reference))
        return bound(norm, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(product / x))

    return bound(_buckets(text, width), similarity)


def _one_of(names: list[str]) -> Callable[[Column], Column]:
    return lambda x: x.isin(*names)


def term_similarities(text: Column, references: Sequence[str]) -> Column:
    """Cosines of the texts' term counts to each reference, as an array, without a vector: only the
    references' terms need a product, and the text's norm comes from its distinct terms. A text is
    split, sorted and folded once for all references."""
    import re

    wanted = [Counter(re.findall(TOKEN, reference.lower())) for reference in references]
    norms = [F.sqrt(F.lit(float(sum(n * n for n in w.values())))) if w else F.lit(0.0) for w in wanted]

    def similarities(terms: Column) -> Column:
        def products(w: Counter) -> Column:
            # the terms of one weight at a time: a lookup in a set for each
            by_weight = {n: sorted(k for k, m in w.items() if m == n) for n in sorted(set(w.values()))}
            parts = [F.size(F.filter(terms, _one_of(names))) * n for n, names in by_weight.items()]
            return sum(parts[1:], parts[0])

        def cosines(norm: Column) -> Column:
            return F.array(*[F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(products(w) / (norm * own)) if w else F.lit(0.0) for w, own in zip(wanted, norms, strict=True)])

        return bound(F.sqrt(squared_counts(terms, F.lit("")).cast("double")), cosines)

    return bound(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), similarities)


def term_similarity(text: Column, reference: str) -> Column:
    """``term_similarities`` to one reference."""
    return F.get(term_similarities(text, [reference]), F.lit(0))


def with_similarity(rows: DataFrame, reference: list[float] | Column, vector_col: str = "content_embedding") -> DataFrame:
    """Adds ``similarity`` to a reference vector, which travels as a literal."""
    vector = reference if isinstance(reference, Column) else F.array(*[F.lit(float(x)) for x in reference])
    return rows.withColumn("similarity", cosine(F.col(vector_col), vector))


HASHED = register(Embedder("hash", 64, expression=hashed_embedding))


def embed_and_compare(rows: DataFrame, reference_text: str, text_col: str = "content", width: int = 64, embedder: Embedder = HASHED) -> DataFrame:
    """Adds ``content_embedding`` and ``similarity`` to the reference text, whose vector is one
    broadcast row, made where all others are. The similarity of the hashed embedding does not read
    the embedding column, so that is made only where a later stage selects it."""
    spark = rows.sparkSession
    if embedder is HASHED:
        reference = spark.range(1).select(hashed_embedding(F.lit(reference_text), width).alias("_reference"))
        out = rows.withColumn("content_embedding", hashed_embedding(F.col(text_col), width)).crossJoin(F.broadcast(reference))
        return out.withColumn("similarity", hashed_similarity(F.col(text_col), F.col("_reference"), width)).drop("_reference")
    reference = embedded(spark.range(1).select(F.lit(reference_text).alias("_text")), embedder, "_text", "_reference").select("_reference")
    out = embedded(rows, embedder, text_col).crossJoin(F.broadcast(reference))
    return out.withColumn("similarity", cosine(F.col("content_embedding"), F.col("_reference"))).drop("_reference")


def _order(similarity: str, ties: tuple[str, ...]) -> list[Column]:
    return [F.nanvl(F.coalesce(F.col(similarity), F.lit(float("nan"))), F.lit(-2.0)).desc(), *[F.col(t) for t in ties]]


def top_by_group(rows: DataFrame, n: int, keys: tuple[str, ...] = ("doc_id",), similarity: str = "similarity", ties: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The n most similar rows of each group, with ``rank`` from 1; NaN and null come last. Spark
    cuts each partition to n rows a group before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*_order(similarity, ties))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_rows(rows: DataFrame, n: int, similarity: str = "similarity", ties: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The n most similar rows of all, in that order."""
    return rows.orderBy(*_order(similarity, ties)).limit(n)


def top_by_references(rows: DataFrame, similarities: dict[str, Column], n: int, keys: tuple[str, ...] = ("doc_id",), ties: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The n rows of each group that are most similar to each of several references: adds
    ``reference``, ``similarity`` and ``rank``.

    One pass for all references: a row gets an entry for each, and every task keeps the best n of a
    group and reference before the shuffle, so what moves does not grow with the rows of a group.
    """
    entries = F.array(*[F.struct(F.lit(name).alias("reference"), value.cast("double").alias("similarity")) for name, value in similarities.items()])
    each = rows.select("*", F.explode(entries).alias("_entry")).select(*[F.col(f"`{c}`") for c in rows.columns], "_entry.reference", "_entry.similarity")
    return top_by_group(each, n, (*keys, "reference"), ties=ties)
