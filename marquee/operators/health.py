"""Health of sources from their runs: latest runs, median baseline, anomaly, freshness, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import latest

HISTORY, MINIMUM, LEAST_BASELINE, SHARE = 7, 3, 5, 0.5


def baselines(runs: DataFrame, history: int = HISTORY) -> DataFrame:
    """Per source of runs (source, started_at, status, collected_count): the latest run, runs seen, and the median of earlier successes among the last `history` runs."""
    last = latest(runs, ["source"], [F.col("started_at").desc()], history)
    good = F.filter("runs", lambda r: r["status"] == "success")
    packed = last.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "status", F.col("collected_count").cast("double").alias("n")))).alias("runs"))
    earlier = F.sort_array(F.transform(F.slice(good, 2, history), lambda r: r["n"]))
    m = F.size(earlier)
    middle = (F.get(earlier, F.floor((m - 1) / 2).cast("int")) + F.get(earlier, F.floor(m / 2).cast("int"))) / 2
    return packed.select(
        "source", F.size("runs").alias("n_runs"), F.get("runs", F.lit(0))["status"].alias("last_status"), F.get("runs", F.lit(0))["n"].alias("last_count"), F.when(m > 0, middle).alias("median_collected")
    )


def status(names: DataFrame, runs: DataFrame, upcoming: DataFrame, allow_empty: tuple[str, ...] = (), minimum: int = MINIMUM) -> DataFrame:
    """Per requested source: status by priority and the anomaly flag. upcoming: (source, in_window, next_event)."""
    rows = names.join(baselines(runs), "source", "left").join(upcoming, "source", "left")
    failed, ok = F.col("last_status") == "error", F.col("last_status") == "success"
    empty = ok & (F.col("last_count") == 0) & ~F.col("source").isin(*allow_empty)
    drop = ok & (F.col("last_count") > 0) & (F.col("median_collected") >= LEAST_BASELINE) & (F.col("last_count") < SHARE * F.col("median_collected"))
    quiet = F.col("next_event").isNotNull() & (F.coalesce("in_window", F.lit(0)) == 0)
    found = (
        F.when(F.col("n_runs").isNull(), "unknown").when(failed, "down").when(empty, "degraded").when(drop, "degraded").when(quiet, "quiet").when(F.col("n_runs") < minimum, "warming").otherwise("healthy")
    )
    return rows.select("source", found.alias("status"), F.coalesce(failed | drop, F.lit(False)).alias("anomaly"), F.coalesce(empty, F.lit(False)).alias("zero_result"), "last_count", "median_collected", "next_event")


def overall(statuses: DataFrame) -> DataFrame:
    """One row: degraded if any source is down or degraded, warming if any is unknown, else healthy."""
    return statuses.agg(F.when(F.bool_or(F.col("status").isin("down", "degraded")), "degraded").when(F.bool_or(F.col("status") == "unknown"), "warming").otherwise("healthy").alias("overall"))
