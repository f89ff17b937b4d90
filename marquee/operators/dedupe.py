"""Keeping one row of many, with an explicit order, and pairs within a band of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order: a grouped minimum of structs, so rows are combined before the shuffle."""
    names = df.columns
    best = df.groupBy(*keys).agg(F.min(F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), F.struct(*names).alias("row"))).alias("best"))
    return best.select("best.row.*")


def keep_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key by position, with the first position (as a dictionary keeps it)."""
    names = [c for c in df.columns if c != position]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names), position).alias("row"), F.min(position).alias(position))
    return best.select("row.*", position)


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by order, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def band_pairs(left: DataFrame, right: DataFrame, ts: str, seconds: int, keys: list[str] = ()) -> DataFrame:
    """Pairs l, r of equal keys whose times differ by seconds at most (inclusive): an equi-join on time cells, one side in three cells."""
    cell = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    l = left.select(F.struct(*left.columns).alias("l"), *(F.col(k).alias(f"_{k}") for k in keys), cell.alias("_cell"))
    r = right.select(F.struct(*right.columns).alias("r"), *(F.col(k).alias(f"_{k}") for k in keys), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    gap = F.abs(F.unix_micros(F.col(f"l.{ts}").cast("timestamp")) - F.unix_micros(F.col(f"r.{ts}").cast("timestamp")))
    return l.join(r, [*(f"_{k}" for k in keys), "_cell"]).where(gap <= seconds * 1_000_000).select("l", "r")


def overlapping_sets(left: DataFrame, left_key: str, right: DataFrame, right_key: str, share: float, least: int) -> DataFrame:
    """(left_key, right_key, shared): pairs of sets of words (key, w: array without repeats) that share `share` of the smaller set of `least` words at least.

    Sets meet in the list of each word they share, and what meets is two keys and two sizes; the words of a pair are counted,
    partly before the shuffle, and never carried along. Where the share is low nearly all pairs have a word in common, so
    looking up rare words alone leaves none out and pays for the sets of every pair.
    """
    word = lambda df, key, k, n: df.select(F.col(key).alias(k), F.size("w").alias(n), F.explode("w").alias("x")).where(F.col(n) >= least)
    met = word(left, left_key, "i", "n").join(word(right, right_key, "j", "m"), "x").groupBy("i", "j", "n", "m").agg(F.count("*").alias("shared"))
    return met.where(F.col("shared") >= share * F.least("n", "m")).select(F.col("i").alias(left_key), F.col("j").alias(right_key), "shared")
