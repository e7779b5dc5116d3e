"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_format, collocations, mixing, suffix_trees, url_filters
from .chat_format import as_events, chat_digests
from .frames import table
from .licenses import license_scan
from .near_copies import near_copies
from .neighbours import nearest
from .pieces import encode_pieces
from .quality_rules import fit_quality, quality_rules
from .repeats import cut_repeats
from .token_counts import token_counts

PIECE_MODEL = "piece_bpe_32k.model"
#: Turns that hold the control strings of this and of a common template.
TRICKY = [(-7, t, role, r"\### Assistant: </turn> ok") for t, role in enumerate(("user", "assistant"))]
BAD = "CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END"


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter("vec_id % 50 = 0"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is that of the labels row with its id: bad if its quality
    is 0 or it is toxic."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr(BAD).alias("bad"))
    return url_filters.url_filters(table(spark, sf_dir, "pages"), outcomes)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("findings")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_digests(as_events(rows))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), keep_ids=False)


def op11_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_trees.cut_windows(table(spark, sf_dir, "documents")).drop("kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_near_copies, op2_neighbours, op3_quality_rules, op4_url_filters, op5_suffix_array, op6_license_scan, op7_token_counts, op8_mixing, op9_chat_format, op10_sentencepiece, op11_suffix_trees, op12_collocations, op13_centroids)}
ORACLE_SQL: dict[str, str] = {"op4_url_filters": url_filters.oracle(), "op8_mixing": mixing.oracle(), "op9_chat_format": chat_format.oracle(TRICKY), "op11_suffix_trees": suffix_trees.oracle(), "op12_collocations": collocations.oracle(), "op13_centroids": centroids.oracle()}
