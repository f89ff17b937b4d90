"""Quality rules over event rows: issues, the batch gate, summaries, and dates recovered from titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeutil

HTTP = r"(?i)^https?:"


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def issues(df: DataFrame, now: str) -> DataFrame:
    """(source, external_id, severity, code) in the order of the rules; df: source, external_id, title, source_url, start_at, ticket_url."""
    at = F.lit(now).cast("timestamp_ntz")
    rules = [
        ("error", "missing_external_id", blank(F.col("external_id"))),
        ("error", "missing_title", blank(F.col("title"))),
        ("error", "missing_source_url", blank(F.col("source_url"))),
        ("error", "invalid_source_url", ~blank(F.col("source_url")) & ~F.col("source_url").rlike(HTTP)),
        ("error", "missing_start_at", F.col("start_at").isNull()),
        ("error", "past_event", F.col("start_at") < at),
        ("warning", "invalid_ticket_url", (F.coalesce("ticket_url", F.lit("")) != "") & ~F.col("ticket_url").rlike(HTTP)),
    ]
    found = F.array(*(F.when(hit, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, hit in rules))
    return df.select("source", "external_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue")).select("source", "external_id", "issue.*")


def gate(df: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of sources without an error: one error rejects the source's batch."""
    bad = found.where("severity = 'error'").select("source").distinct()
    return df.join(bad, "source", "left_anti")


def summary(df: DataFrame, found: DataFrame) -> DataFrame:
    """(source, collected, errors, warnings); sources without issues too."""
    rows = df.groupBy("source").agg(F.count("*").alias("collected"))
    per = found.groupBy("source").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return rows.join(per, "source", "left").select("source", "collected", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def with_recovered_dates(df: DataFrame, now: str) -> DataFrame:
    """df with start_at filled from the title where it is missing, and recovered."""
    found = timeutil.date_in_text(F.col("title"), F.lit(now).cast("timestamp")).cast("timestamp_ntz")
    return df.withColumn("recovered", F.col("start_at").isNull() & found.isNotNull()).withColumn("start_at", F.coalesce("start_at", found))
