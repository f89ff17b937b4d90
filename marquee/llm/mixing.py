"""Mixing sources to target weights: token totals, repetition rates, and floor(rate) copies plus a hash-seeded Bernoulli one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import Scratch
from .common import free_names, md5_unit, n_words

WEIGHTS = (5, 2, 1)
MOST = 3


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source; null is a source like any other.

    Sources by code point, null last, get weights in turn and share the sum of all sizes by them. A target stops at most
    times its source's size; the excess is shared anew by weight until none is above. In the order of cap by weight the
    capped sources come first, so running sums give all shares at once. The windows run in one task
    over one row per source: good for millions of sources, not for one source per document.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    table = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest, whole = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    table = table.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(rest).alias("to"),
    ).withColumn("full", F.col("cap") * F.col("to") <= F.col("weight") * F.col("left"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("none"), "source", "left", "to"))).over(whole)
    return table.withColumn("first", first).select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("first.left") / F.col("first.to")).alias("target")
    )


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for docs (source, size): sizes are summed by source and a part of the source's rows first."""
    return targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)


def with_copies(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and copies; columns of these names are replaced, all others stay.

    size is the number of words (null text: none). The rate of a source is target / source_size; a document is taken
    floor(rate) times, and once more if its hash draw, from seed and doc_id alone, is below the fraction. Sources without
    words have rate 0. Rows that repeat a doc_id draw alike; a null doc_id draws as the empty string does. Texts may be of any
    length. An empty table gives an empty result. The targets' table has one row per source and is written once, so that the
    join can be dealt by source and a hot source split.
    """
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    docs = docs.select(*names).withColumn("size", n_words(F.col("text")))
    scratch = Scratch(docs.sparkSession, "mixing", scratch)
    (of,) = free_names([*docs.columns, "source_size", "target", "copies"], "of_source")
    found = scratch.cut(rates(docs, weights, most), "targets").withColumnRenamed("source", of)
    joined = docs.join(found, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.withColumn("copies", (F.floor(rate) + F.when(draw(seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def draw(seed: str) -> Column:
    return md5_unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mixed(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs, whatever their names."""
    given = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    taken = with_copies(given, seed, weights, most, scratch).where("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares,
  row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
f AS (SELECT *, cap * shares <= weight * rest AS is_full FROM o),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
  weight * (SELECT arg_min(rest, k) FROM f WHERE NOT is_full)::DOUBLE / (SELECT arg_min(shares, k) FROM f WHERE NOT is_full)::DOUBLE END AS target FROM f),
j AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM j
"""
