"""URL rules by a sort-merge range join.

A rule is a host and a path. Hosts are reversed by label ("example.net" is "net.example."), so that a host and all its
subdomains are one interval of keys, and intervals are nested or apart. Keys of urls and both ends of intervals are dealt
out by ranges of the sort order, with a hash behind a url's key so that ranges can cut through one busy host; a rule goes
to every range that its interval meets. Within a range one sweep in sort order keeps a stack of the rules whose interval
is open, and a url looks down that stack for the longest rule whose path starts its own.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys per range when cutting the order into ranges: it decides about balance only.
SAMPLE = 50
_LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z folded; empty if there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each closed by U+0001, which sorts before all that hosts are made of."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")))


def judged(urls: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of urls (page_id, url) by rules (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest (host and path together)
    wins, of equally long ones block, then the least. Without a fitting rule rule is null and verdict is `otherwise`. A rule
    with a null path fits all paths; one without host or verdict is none; repeated rules are one. A null url, or one without
    ://, has empty host and path and meets no rule; urls may be of any length. Repeated rows each get a row; empty tables of
    urls or rules work; other columns are ignored. Memory: the rules open at one point of the sweep.
    """
    spark = urls.sparkSession
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("\x02"), F.lpad(F.hex(F.xxhash64("page_id", "path")), 16, "0")))
    host = F.lower("host")
    rules = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict", reversed_host(host).alias("key")).where("key <> '' and verdict is not null").distinct()
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sample = [r.key for r in urls.select("key", F.xxhash64("page_id", "host").alias("h")).orderBy("h").limit(SAMPLE * ranges).select("key").orderBy("key").collect()]
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def place(key):
        return key.map(lambda k: bisect_right(cuts, k)).astype("int32")

    empty = F.lit(None).cast("string")
    points = urls.select(place("key").alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", empty.alias("verdict"))
    within = F.expr("sequence(first, last)")
    opened = (
        rules.withColumn("first", place("key"))
        .withColumn("last", place(F.concat("key", F.lit(_LAST))))
        .select(F.explode(within).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["page_id"].dataType).alias("page_id"), "host", "path", "verdict")
    )
    # Spark sorts strings by their UTF-8 bytes, Python by code point: the same order.

    def sweep(batches):
        stack: list[tuple] = []
        part = None
        for batch in batches:
            out = {k: [] for k in ("page_id", "host", "path", "rule", "verdict")}
            for p, key, kind, page, host, path, verdict in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    stack.append((key, host, path, verdict))
                    continue
                best = max(((len(r[1]) + len(r[2]), r[3] == "block", r) for r in stack if path.startswith(r[2]) and (host == r[1] or host.endswith("." + r[1]))), default=None, key=lambda x: (x[0], x[1], [-ord(c) for c in x[2][1] + x[2][2]]))
                out["page_id"].append(page)
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(best[2][1] + best[2][2] if best else None)
                out["verdict"].append(best[2][3] if best else otherwise)
            kinds = [batch.schema.field(3).type, *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    kind = dict(urls.dtypes)["page_id"]
    dealt = points.unionByName(opened).repartitionByRange(ranges, "part").sortWithinPartitions("part", "key", "kind")
    return dealt.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")
