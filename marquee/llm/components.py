"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch


def _star(pairs: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """pairs: (u, v), u over v. Large: every larger neighbour of u is hung on u's least neighbour; small: every smaller one, and u."""
    seen = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = scratch.cut(seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")  # a table, so that Spark can split a hot u in the join
    hung = seen.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of links (u, v): the least node that can be reached.

    Links may repeat, point either way or join a node to itself; nodes without a link to another node are left out.
    The number of rounds grows with the logarithm of the graph's size; every round is written, and the result is a table of scratch.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    own = Scratch(links.sparkSession, "stars", scratch)
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    last = None
    while True:
        pairs = own.cut(_star(_star(pairs, True, own), False, own), "pairs")
        own.keep_only(pairs)
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if last == tuple(state):
            found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            found = scratch.cut(found.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            own.close()
            return found
        last = tuple(state)
