"""Hierarchical weighted hash tree: regions hold racks, racks hold shards; a row descends by weighted hash draws.

At each level every child draws ln(u) / weight with u hashed from the child's path and the key; the largest draw wins.
A child's draws don't depend on its siblings, so a changed weight moves rows only into or out of the subtree that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import Scratch
from .common import free_names, md5_unit

#: name, racks: (name, shards: (number, weight))
Tree = list[tuple[str, list[tuple[str, list[tuple[int, float]]]]]]
BASE, RACK, REGION = 24, 4, 12
#: Rows of a shard that one task numbers, about.
SLOT_ROWS = 1 << 20
#: Hot cells up to which their table is broadcast.
HOT_CELLS = 100_000


def tree(shards: int = BASE, base: int = BASE) -> Tree:
    """base shards in racks of 4 and regions of 12; each further shard is a region of its own, so that growth moves rows only into it."""
    out: Tree = []
    for k in range(0, min(shards, base), REGION):
        last = min(k + REGION, min(shards, base))
        out.append((f"region{k // REGION}", [(f"rack{r // RACK}", [(s, 1.0) for s in range(r, min(r + RACK, last))]) for r in range(k, last, RACK)]))
    return out + [(f"added{k}", [("rack", [(k, 1.0)])]) for k in range(base, shards)]


def _pick(key: Column, children: list[tuple[str, float]]) -> Column:
    """Number of the child (path, weight) with the largest weighted draw."""
    if len(children) == 1:
        return F.lit(0)
    draws = (F.struct((F.log(md5_unit(F.concat(F.lit(f"{path}:"), key))) / weight).alias("draw"), F.lit(k).alias("child")) for k, (path, weight) in enumerate(children))
    return F.array_max(F.array(*draws))["child"]


def _each(chosen: Column, values: list[Column]) -> Column:
    """The value at the chosen place; the others are not computed."""
    out = F.when(chosen == 0, values[0])
    for k, value in enumerate(values[1:], 1):
        out = out.when(chosen == k, value)
    return out


def with_shard(rows: DataFrame, key: Column, of: Tree, name: str) -> DataFrame:
    """rows with the shard of a string key as column name; a null key counts as the empty string. One level after the other."""
    key = F.coalesce(key, F.lit(""))
    weigh = lambda racks: sum(w for _, shards in racks for _, w in shards)
    a, b = free_names([*rows.columns, name], "region", "rack")
    region, rack = F.col(a), F.col(b)
    rows = rows.withColumn(a, _pick(key, [(r, weigh(racks)) for r, racks in of]))
    rows = rows.withColumn(b, _each(region, [_pick(key, [(f"{r}/{k}", weigh([(k, s)])) for k, s in racks]) for r, racks in of]))
    leaves = [_each(rack, [F.element_at(F.array(*(F.lit(s) for s, _ in shards)), _pick(key, [(f"{r}/{k}/{s}", w) for s, w in shards]) + 1) for k, shards in racks]) for r, racks in of]
    return rows.withColumn(name, _each(region, leaves)).drop(a, b)


def sharded(docs: DataFrame, shards: int = BASE, slot_rows: int = SLOT_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """docs with shard, slot and grown_shard (the shard with one more); columns of these names are replaced, all others stay.

    doc_id and the number of shards decide, nothing else: equal ids go to one shard, a null id counts as an empty key.
    slot numbers the rows of a shard without gaps from 0: rows are numbered within a hash part of a shard, and the parts'
    sizes are summed up before; the number of parts follows the number of rows, so no task holds a shard. The rows of an id (or
    a null one) that has more than slot_rows are dealt to parts of their own by a hash of all columns. Within a part rows go by
    doc_id, then by that hash: rows that tie in both are alike, and it makes no difference which comes first.
    Texts may be null, empty or of any length. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    plain = [c for c in names if not dict(docs.dtypes)[c].startswith(("map", "variant"))]  # what Spark can hash
    at, first, tie, sub, own, s, p, q = free_names([*names, "shard", "slot", "grown_shard"], "part", "before", "tie", "sub", "cell", "of_shard", "of_part", "of_sub")
    key = F.col("doc_id").cast("string")
    placed = with_shard(with_shard(docs.select(*names), key, tree(shards), "shard"), key, tree(shards + 1), "grown_shard")
    scratch = Scratch(docs.sparkSession, "shards", scratch)
    cell = F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 5), 16, 10).cast("long")  # 20 bits
    narrow = scratch.cut(placed.select(F.col("shard").alias("s"), cell.alias("h")).groupBy("s", "h").count(), "cells")
    parts = max(64, (narrow.agg(F.sum("count")).first()[0] or 0) // (shards * slot_rows) + 1)
    hot = scratch.cut(narrow.where(F.col("count") > slot_rows).select("s", "h", F.expr(f"count div {slot_rows} + 1").alias("many")), "hot")
    placed = placed.withColumn(tie, F.xxhash64(*plain)).withColumn(at, F.pmod(cell, F.lit(parts)))
    if hot.isEmpty():
        placed = placed.withColumn(sub, F.lit(0).cast("long"))
        sizes = narrow.groupBy(F.col("s").alias(s), F.pmod("h", F.lit(parts)).alias(p), F.lit(0).cast("long").alias(q)).agg(F.sum("count").alias("n"))
    else:  # one key, or all null ones: its rows are dealt by their hash
        of = hot.select(F.col("s").alias(s), F.col("h").alias(p), F.col("many").alias(q))
        placed = placed.withColumn(own, cell)
        placed = placed.join(F.broadcast(of), (F.col("shard") == F.col(s)) & (F.col(own) == F.col(p)), "left") if hot.count() < HOT_CELLS else placed.join(of, (F.col("shard") == F.col(s)) & (F.col(own) == F.col(p)), "left")
        placed = placed.withColumn(sub, F.coalesce(F.col(own) * (1 << 30) + F.pmod(F.col(tie), F.col(q)) + 1, F.lit(0).cast("long"))).drop(s, p, q, own)
        sizes = placed.groupBy(F.col("shard").alias(s), F.col(at).alias(p), F.col(sub).alias(q)).agg(F.count("*").alias("n"))
    before = sizes.withColumn(first, F.coalesce(F.sum("n").over(W.partitionBy(s).orderBy(p, q).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    before = scratch.cut(before, "before")
    scratch.keep_only(before, hot)
    within = F.row_number().over(W.partitionBy("shard", at, sub).orderBy(F.col("doc_id").asc_nulls_last(), tie))
    placed = placed.withColumn("slot", within).join(before, (F.col("shard") == F.col(s)) & (F.col(at) == F.col(p)) & (F.col(sub) == F.col(q)))
    return placed.withColumn("slot", (F.col("slot") - 1 + F.col(first)).cast("long")).select(*names, "shard", "slot", "grown_shard")


def draws_sql(shards: int) -> str:
    """SQL for the shard of a string column k: the same draws, level by level."""
    unit = lambda path: f"(('0x' || substr(md5('{path}:' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
    pick = lambda choices: choices[0][2] if len(choices) == 1 else "(list_max([" + ", ".join(f"{{'d': ln({unit(path)}) / {w}, 'c': {c}}}" for path, w, c in choices) + "])).c"
    of, out = tree(shards), []
    for r, racks in of:
        leaf = lambda rack, found, r=r: pick([(f"{r}/{rack}/{s}", w, s) for s, w in found])
        rack = pick([(f"{r}/{k}", sum(w for _, w in found), n) for n, (k, found) in enumerate(racks)])
        out.append(f"CASE {rack} " + " ".join(f"WHEN {n} THEN {leaf(k, found)}" for n, (k, found) in enumerate(racks)) + " END")
    region = pick([(r, sum(w for _, found in racks for _, w in found), n) for n, (r, racks) in enumerate(of)])
    return f"CASE {region} " + " ".join(f"WHEN {n} THEN {x}" for n, x in enumerate(out)) + " END"
