"""Sentences packed into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, sentences, strip, token_count


def packed(pairs: Column, max_tokens: int) -> Column:
    """Greedy packing of an array of (text, n) into an array of (content, n_tokens).

    A sentence that would pass the cap starts a new chunk, so one over the cap is its own chunk.
    The fold keeps only where chunks begin; their texts are cut out and joined once.
    """
    start = F.struct(F.expr("cast(array() as array<int>)").alias("begins"), F.lit(0).alias("i"), F.lit(0).alias("n_tokens"))

    def step(acc: Column, n: Column) -> Column:
        fresh = (acc["i"] == 0) | (acc["n_tokens"] + n > max_tokens)
        begins = F.when(fresh, F.concat(acc["begins"], F.array(acc["i"]))).otherwise(acc["begins"])
        return F.struct(begins.alias("begins"), (acc["i"] + 1).alias("i"), F.when(fresh, n).otherwise(acc["n_tokens"] + n).alias("n_tokens"))

    def cut(rows: Column, begins: Column) -> Column:
        def chunk(begin: Column, k: Column) -> Column:
            part = F.slice(rows, begin + 1, F.coalesce(F.get(begins, k + 1), F.size(rows)) - begin)
            total = F.aggregate(F.transform(part, lambda r: r["n"]), F.lit(0), lambda s, x: s + x)
            return F.struct(F.array_join(F.transform(part, lambda r: r["text"]), " ").alias("content"), total.alias("n_tokens"))

        return F.transform(begins, chunk)

    def chunks(rows: Column) -> Column:
        return bound(F.aggregate(F.transform(rows, lambda r: r["n"]), start, step, lambda acc: acc["begins"]), lambda begins: cut(rows, begins))

    return bound(pairs, chunks)


def pack_chunks(pages: DataFrame, max_tokens: int = 200, count=token_count, keys: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """(keys, chunk_no, content, n_tokens): consecutive sentences of each row's text up to
    max_tokens. Chunks never cross rows (pages), and there is no shuffle."""
    pairs = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("text"), count(s).alias("n")))
    chunks = pages.select(*keys, F.posexplode(packed(pairs, max_tokens)).alias("chunk_no", "chunk"))
    return chunks.select(*keys, "chunk_no", strip(F.col("chunk.content")).alias("content"), "chunk.n_tokens")
