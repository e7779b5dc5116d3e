"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

Part of the training-data operators (``paperloom.llm``). Every stage works on all rows that the
one before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.frames import stored, table
from paperloom.llm.mixing import mix_documents
from paperloom.llm.near_copies import drop_near_copies
from paperloom.llm.pieces import encode_pieces
from paperloom.llm.quality_rules import fit_quality, keep_quality
from paperloom.llm.repeats import without_repeats

PIECE_MODEL = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id."""
    return drop_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document of smaller id has."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in training order."""
    return mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy."""
    return encode_pieces(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [("quality rules", quality), ("near-copy dedup", near_dedup), ("passage dedup", passage_dedup), ("source mixing", mix), ("piece encoding", encode)]
#: Alignment, fingerprint sorting and piece paths have no form in SQL; tests/llm hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
