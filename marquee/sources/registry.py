"""The table of sources: bindings of names to addresses and readers, and its check."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import month_urls


class Source(NamedTuple):
    name: str
    base_url: str
    read: Callable[..., DataFrame] | None
    production: bool = True


def addresses(base: str, now: str, months: int = 4, categories: tuple[str, ...] = ()) -> list[str]:
    """The base address, its next months' pages and its categories' pages."""
    return [base, *month_urls(base, now, months), *(f"{base.rstrip('/')}/{c}/" for c in categories)]


def problems(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(number, problem) for every fault of production sources: names empty or repeated, addresses not absolute or repeated, readers that can't be called.

    Numbers count from 1; of repeated values the first is no fault.
    """
    rows = [(k, s.name if isinstance(s.name, str) else None, s.base_url if isinstance(s.base_url, str) else None, callable(s.read)) for k, s in enumerate((s for s in sources if s.production), 1)]
    df = spark.createDataFrame(rows, "number int, name string, url string, callable boolean")
    fine = F.col("url").rlike("^https?://")
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    firsts = lambda c, where: df.where(where).groupBy(c).agg(F.min("number").alias("first"))
    df = df.join(firsts("name", ~blank).withColumnRenamed("first", "name_first"), "name", "left").join(firsts("url", fine).withColumnRenamed("first", "url_first"), "url", "left")
    rules = [
        (blank, F.lit("name must be a non-empty string")),
        (~blank & (F.col("name_first") < F.col("number")), F.concat(F.lit("duplicate name "), "name")),
        (~F.coalesce(fine, F.lit(False)), F.lit("base_url must be an absolute HTTP(S) URL")),
        (fine & (F.col("url_first") < F.col("number")), F.concat(F.lit("duplicate base_url "), "url")),
        (~F.col("callable"), F.lit("read must be callable")),
    ]
    found = F.array_compact(F.array(*(F.when(hit, what) for hit, what in rules)))
    return df.select("number", F.explode(found).alias("problem"))


def validate(spark: SparkSession, sources: list[Source]) -> None:
    """Raise with all faults at once."""
    found = [f"production source #{r.number}: {r.problem}" for r in problems(spark, sources).orderBy("number", "problem").collect()]
    if found:
        raise RuntimeError("Invalid registry of sources:\n- " + "\n- ".join(found))
