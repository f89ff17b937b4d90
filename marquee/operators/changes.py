"""Snapshots and their change log: set-based upsert, change rows per field, key propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = ("title", "category", "start_at", "price_text", "ticket_url")


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: the greatest by its other columns, where a snapshot repeats a key (dedupe.keep_last keeps the last by a position)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*(c if c in keys else f"_row.{c}" for c in df.columns))


def changes(old: DataFrame, new: DataFrame, keys: list[str], tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """(keys, change_type, field_name, old_value, new_value): created rows, and one row per changed field, compared null-safe by value.

    A key that a snapshot repeats counts once.
    """
    o, n = once(old, keys).withColumn("_known", F.lit(True)).alias("o"), once(new, keys).alias("n")
    both = n.join(o, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left")
    known = F.col("o._known").isNotNull()

    def kind(field: str):
        a, b = F.coalesce(F.col(f"o.{field}").cast("string"), F.lit("")) != "", F.coalesce(F.col(f"n.{field}").cast("string"), F.lit("")) != ""
        if field == "ticket_url":
            return F.when(~a & b, "ticket_sale_started").when(a & ~b, "ticket_link_removed").otherwise("ticket_link_changed")
        return F.lit({"price_text": "price_changed", "start_at": "date_changed"}.get(field, "field_changed"))

    row = lambda t, f, a, b: F.struct(t.alias("change_type"), f.alias("field_name"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"))
    none = F.lit(None).cast("string")
    found = [F.when(~known, row(F.lit("event_created"), none, none, none))]
    found += [F.when(known & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), row(kind(c), F.lit(c), F.col(f"o.{c}"), F.col(f"n.{c}"))) for c in tracked]
    return both.select(*(F.col(f"n.{k}") for k in keys), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("c")).select(*keys, "c.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_if_missing: tuple[str, ...] = ("venue",)) -> DataFrame:
    """The next snapshot: new rows over old ones by key, each key once; a missing value of keep_if_missing keeps the old one."""
    o, n = once(old, keys).alias("o"), once(new, keys).withColumn("_fresh", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    fresh = F.col("n._fresh").isNotNull()
    value = lambda c: F.when(fresh & F.col(f"n.{c}").isNotNull() if c in keep_if_missing else fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(value(c).alias(c) for c in old.columns))


def propagated_keys(rows: DataFrame, cluster: str = "cluster", key: str = "group_key", least: int = 2) -> DataFrame:
    """rows with canonical_key, the least key of a cluster of `least` rows or more, and whether it is new."""
    best = rows.groupBy(cluster).agg(F.min(key).alias("canonical_key"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return rows.join(best, cluster).withColumn("reassigned", F.col(key) != F.col("canonical_key"))


def key_log(propagated: DataFrame, ids: list[str], key: str = "group_key") -> DataFrame:
    """Log rows (ids, change_type, field_name, old_value, new_value) of rows that propagated_keys gave another key."""
    return propagated.where("reassigned").select(*ids, F.lit("canonical_group_assigned").alias("change_type"), F.lit(key).alias("field_name"), F.col(key).alias("old_value"), F.col("canonical_key").alias("new_value"))
