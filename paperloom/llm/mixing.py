"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source demands ``target`` words over training time 0..1. Its weight schedule at time t is
1 + slope * (2t - 1), so the demand met by time t is the integral
``target * ((1 - slope) * t + slope * t**2)``. A document's words have a place in the source's
stream (documents in hash order, again and again); inverting the integral at that place gives
its training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3


def _sources(sized: DataFrame) -> DataFrame:
    """One row a source: size, weight (1, 2, 3 by code point, repeating; null last) and target.

    Targets share the total by weight but stop at three times the source's size. With sources
    sorted by size over weight, those up to some place are full and the rest get level * weight:
    the first place whose level stays under its limit is found by running sums.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit_level", F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        per.withColumn("weight", (F.row_number().over(named) - 1) % 3 + 1)
        .withColumn("limit_level", MOST_COPIES * F.col("source_size") / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum(MOST_COPIES * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("trial", F.col("rest") / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("trial") < F.col("limit_level"), F.struct("limit_level", "trial"))).over(every)["trial"])
        .withColumn("target", F.least((MOST_COPIES * F.col("source_size")).cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "weight", F.round("target", 6).alias("target"))
    )


def _invert(share: Column, slope: Column) -> Column:
    """The time t at which (1 - slope) * t + slope * t**2 equals share."""
    straight = F.abs(slope) < 1e-9
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(straight, share).otherwise((root - (1 - slope)) / F.when(straight, F.lit(1.0)).otherwise(2 * slope))


def mixture(docs: DataFrame, slope: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Return id, size, source_size, target, taken, position and weight of every row.

    taken: words that the mix takes from the row, whole copies and at most one cut one a source;
    it never exceeds three times its size, and a source's rows sum to its target rounded. position:
    that of its first copy, null where nothing is taken. A source's schedule has slope
    ``slope * (weight - 2)``: light sources fade, heavy ones grow.

    Documents go in order of the md5 of their id, so reruns agree. Running sums go over the first
    three hexadecimal digits first and then within each such bucket, so a source that holds a
    third of all rows is summed by 4096 tasks' worth of windows. Null source: a source of its
    own, last. Null text: size 0. A null id sorts as an empty string; repeated rows each count
    and share their places; an empty table gives an empty result; other columns are left out.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), row.alias("row"))
    sized = stored(sized, "sizes").withColumn("digest", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("digest", 1, 3))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    sources = _sources(sized)
    plan = buckets.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("b.source").alias("plan_source"), F.col("b.bucket").alias("plan_bucket"), "offset", "source_size", "weight", "target")
    inner = Window.partitionBy("source", "bucket").orderBy("digest", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("bucket") == F.col("plan_bucket")))
        .withColumn("place", F.col("offset") + F.col("within"))
        .withColumn("wanted", F.round("target").cast("long"))
        .withColumn("copies", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)))
        .withColumn("left_over", F.col("wanted") - F.col("copies") * F.col("source_size"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.greatest(F.lit(0), F.least("size", F.col("left_over") - F.col("place"))))
    )
    at = _invert(F.col("place") / F.col("wanted"), slope * (F.col("weight") - 2.0))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.when(F.col("taken") > 0, F.round(at, 6)).alias("position"), "weight", "place", "wanted", *([F.col("row").alias(row_col)] if row_col else []))


def training_order(mixed: DataFrame, slope: float = 0.5, id_col: str = "doc_id", row_col: str | None = None) -> DataFrame:
    """One row a copy: id, copy (from 0), copy_words (its size, less in a cut one) and position,
    range-sorted by position (ties by id and copy). Rows of which nothing is taken, such as those
    without a word, are left out; a null id stays null; repeated rows each give their copies; an
    empty table gives an empty result; other columns are left out."""
    each = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))))
    share = (F.col("copy") * F.col("source_size") + F.col("place")) / F.col("wanted")
    out = each.select(
        F.col(id_col), "copy", F.least("size", F.col("taken") - F.col("copy") * F.col("size")).alias("copy_words"), "size",
        _invert(share, slope * (F.col("weight") - 2.0)).alias("position"),
        *([row_col] if row_col else []),
    )
    return out.orderBy("position", id_col, "copy")


def mix_documents(docs: DataFrame, slope: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the columns of docs, a row for each copy taken, in training order.

    A cut copy keeps its first words up to the cut, with the space between them. Rows are stored
    under a number of their own that names the text to copy, so rows with a null id or one that
    repeats are each copied as often as the mixture says. A null or empty text has no words and is
    taken no copy of; a null source is a source of its own, last; ties of position go by id, copy
    and row. A very long text is copied whole. An empty table gives an empty result. The columns
    travel inside one of their own, so no name can clash.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(F.monotonically_increasing_id().alias("key"), kept.alias("row")), "rows")
    flat = rows.select("key", F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source"))
    order = stored(training_order(mixture(flat, slope, row_col="key", id_col="id"), slope, "id", "key"), "order")
    joined = rows.join(order, "key").withColumn("text", F.col("row")[text_col])
    whole = F.col("copy_words") >= F.col("size")
    # what stands before the word after the cut, by one pass of a bounded repetition
    cut = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, cast(copy_words as int)), '')")
    joined = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    columns = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(whole, columns["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return joined.orderBy("position", "id", "copy", "key").select(*[columns[c].alias(c) for c in docs.columns])


def oracle(slope: float = 0.5) -> str:
    """The mixture in DuckDB SQL, over documents."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
limited AS (SELECT *, 3 * source_size::DOUBLE / weight AS limit_level FROM weighted),
tried AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS trial
  FROM limited WINDOW w AS (ORDER BY limit_level, source NULLS LAST)),
level AS (SELECT arg_min(trial, limit_level) FILTER (trial < limit_level) AS level FROM tried),
targets AS (
  SELECT source, source_size, weight, round(least(3.0 * source_size, coalesce(level, 0) * weight)::DOUBLE, 6) AS target FROM tried, level),
placed AS (
  SELECT doc_id, size, source_size, weight, target, round(target)::BIGINT AS wanted,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS copies FROM placed),
taken AS (
  SELECT *, (copies * size + greatest(0, least(size, wanted - copies * source_size - place)))::BIGINT AS taken,
         {slope} * (weight - 2.0) AS s, place / nullif(wanted, 0)::DOUBLE AS share FROM copied)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN abs(s) < 1e-9 THEN share ELSE (sqrt((1 - s) * (1 - s) + 4 * s * share) - (1 - s)) / (2 * s) END::DOUBLE, 6) + 0.0::DOUBLE END AS position
FROM taken"""
