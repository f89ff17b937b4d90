"""Queries of the event engine over the driver's tables, each with its SQL where SQL can say it.

The tables play parts: `events` are occurrences (key: user and type), `orders` are offers or subscriptions of `customer`,
daily counts of an event type are a source's runs, `pages` are fetched pages, `documents` are titles and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, timeutil
from ..operators import canonical, changes, dedupe, health, quality, state
from ..sources import cards
from ..sources import pages as page_sources
from ..streaming import jobs
from . import entries

NOW, DAY = "2024-01-15 00:00:00", "2024-01-15"
_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}


# ---- ranges, filters, search ---------------------------------------------------------------------------------------


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' AND event_type <> 'error' ORDER BY ts NULLS LAST, event_id")
def day_events(spark, d):
    return t(spark, d, "events").where(timeutil.in_range(F.col("ts"), DAY, "2024-01-16") & (F.col("event_type") != "error")).select("event_id", "ts", "event_type").orderBy(F.col("ts").asc_nulls_last(), "event_id")


@query("""SELECT event_id, (ts::DATE + ((6 - isodow(ts::DATE) + 7) % 7)::INT)::DATE AS weekend, isodow(ts) >= 6 AS in_weekend FROM events
WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-22'""")
def weekend_events(spark, d):
    rows = t(spark, d, "events").where(timeutil.in_range(F.col("ts"), "2024-01-20", "2024-01-22"))
    return rows.select("event_id", timeutil.weekend_start(F.to_date("ts")).alias("weekend"), (F.weekday("ts") >= 5).alias("in_weekend"))


@query("""SELECT o_orderkey, c_name, n_name, o_orderdate FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01' AND o_orderstatus = 'O'""")
def range_venue_left_join(spark, d):
    rows = t(spark, d, "orders").where(timeutil.in_range(F.col("o_orderdate"), "1998-01-01", "1998-02-01") & (F.col("o_orderstatus") == "O"))
    rows = rows.join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name", "o_orderdate")


@query("""SELECT event_id, start_at FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS start_at FROM events) WHERE start_at IS NULL OR start_at >= TIMESTAMP '2024-01-15' ORDER BY start_at NULLS LAST, event_id""")
def undated_or_future(spark, d):
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("start_at"))
    return rows.where(F.col("start_at").isNull() | (F.col("start_at") >= F.lit(NOW).cast("timestamp_ntz"))).orderBy(F.col("start_at").asc_nulls_last(), "event_id")


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the inthe') OR lower(text) LIKE '%of_the%' ORDER BY doc_id")
def title_search_like(spark, d):
    return t(spark, d, "documents").where(text.like_literal(F.col("text"), "  The  INthe") | text.like_literal(F.col("text"), "of_the", wildcards=True)).select("doc_id", "lang").orderBy("doc_id")


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 60),
f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS cut FROM c),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
SELECT user_id, min(ts) AS start_at, count(*) AS n_rows FROM i GROUP BY user_id, island ORDER BY start_at, user_id LIMIT 20""")
def search_overfetch_cut(spark, d):
    rows = t(spark, d, "events").where(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz")).orderBy("ts", "event_id").limit(60).select("event_id", "user_id", "ts")
    return canonical.islands(rows, ["user_id"], "ts", order=("event_id",)).groupBy("user_id", "island").agg(F.min("ts").alias("start_at"), F.count("*").alias("n_rows")).drop("island").orderBy("start_at", "user_id").limit(20)


# ---- clusters and categories ---------------------------------------------------------------------------------------


@query("SELECT coalesce(nullif(CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN NULL ELSE event_type END, ''), 'Інше') AS category, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, category")
def default_category_counts(spark, d):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("")).when(F.col("event_id") % 10 == 1, F.lit(None)).otherwise(F.col("event_type"))
    return t(spark, d, "events").groupBy(F.coalesce(F.nullif(raw, F.lit("")), F.lit(text.DEFAULT_CATEGORY)).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def _islands_sql(keys: str, minutes: int, where: str = "TRUE") -> str:
    return f"""WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id) > INTERVAL {minutes} MINUTE THEN 1 ELSE 0 END AS cut FROM events WHERE {where}),
i AS (SELECT *, sum(cut) OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)"""




def _event_clusters(spark, d, seconds: int, keys: list[str]) -> DataFrame:
    rows = t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return canonical.clusters(rows, keys, "ts", "event_id", seconds)


@query(_islands_sql("user_id, event_type", 15) + " SELECT category, count(*) AS n FROM (SELECT arg_min(event_type, (ts, event_id)) AS category FROM i GROUP BY user_id, event_type, island) GROUP BY category ORDER BY n DESC, category")
def category_counts_canonical(spark, d):
    best = F.min_by("event_type", F.struct("ts", "event_id")).alias("category")
    rows = _event_clusters(spark, d, 900, ["user_id", "event_type"]).groupBy("user_id", "cluster").agg(best)
    return rows.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(12)


@query(_islands_sql("user_id", 360) + """ SELECT user_id, start_at, n_rows FROM (SELECT user_id, min(ts) AS start_at, count(*) AS n_rows, arg_min(event_type, (ts, event_id)) AS category
FROM i GROUP BY user_id, island) WHERE category = 'purchase'""")
def category_after_cluster(spark, d):
    rows = _event_clusters(spark, d, 6 * 3600, ["user_id"]).groupBy("user_id", "cluster").agg(F.min("ts").alias("start_at"), F.count("*").alias("n_rows"), F.min_by("event_type", F.struct("ts", "event_id")).alias("category"))
    return rows.where("category = 'purchase'").select("user_id", "start_at", "n_rows")


@query(_islands_sql("user_id", 360) + """ SELECT min(event_id) AS cluster, user_id, min(ts) AS start_at, count(*) AS n_rows, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM i GROUP BY user_id, island""")
def canonical_any_member(spark, d):
    kinds = F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds")
    return _event_clusters(spark, d, 6 * 3600, ["user_id"]).groupBy("cluster", "user_id").agg(F.min("ts").alias("start_at"), F.count("*").alias("n_rows"), kinds)


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_type, k, ts AS lead_ts, event_id AS cluster, event_id FROM o WHERE k = 1
UNION ALL SELECT o.user_id, o.event_type, o.k, CASE WHEN o.ts - r.lead_ts <= INTERVAL 720 MINUTE THEN r.lead_ts ELSE o.ts END, CASE WHEN o.ts - r.lead_ts <= INTERVAL 720 MINUTE THEN r.cluster ELSE o.event_id END, o.event_id
FROM r JOIN o ON o.user_id = r.user_id AND o.event_type = r.event_type AND o.k = r.k + 1)
SELECT event_id, cluster FROM r""")
def canonical_leader(spark, d):
    """Leader clusters with an equality key: in time order a row joins the last leader if it is near enough; a fold over the sorted times of an island, as no leader spans a gap of more."""
    rows = canonical.islands(t(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", 720 * 60, ("event_id",))
    at = lambda x: F.struct(F.unix_micros(x["ts"].cast("timestamp")).alias("at"), x["event_id"].alias("cluster"))
    leader = "struct<at:bigint,cluster:bigint>"
    far = lambda a, x: F.coalesce(F.unix_micros(x["ts"].cast("timestamp")) - F.try_element_at(a, F.lit(-1))["at"] > 720 * 60_000_000, F.lit(True))
    # leaders alone are appended, one for each 720 minutes at most; a row's cluster is the last leader before it
    packed = rows.groupBy("user_id", "event_type", "island").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("rows"))
    led = packed.select("rows", F.aggregate("rows", F.array().cast(f"array<{leader}>"), lambda a, x: F.when(far(a, x), F.array_append(a, at(x))).otherwise(a)).alias("leaders"))
    rows = led.select("leaders", F.explode("rows").alias("r"))
    return rows.select("r.event_id", F.array_max(F.filter("leaders", lambda x: x <= at(F.col("r"))))["cluster"].alias("cluster"))


@query(None)
def canonical_fuzzy_titles(spark, d):
    """Greedy leader clusters of titles (a document's first line) over all documents, in the order of doc_id; all have one start and no venue."""
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return canonical.title_clusters(docs, "doc_id").select("doc_id", "cluster")


def listings(docs: DataFrame) -> DataFrame:
    """Listings (ord, title, start_at, venue, group_key) of all documents, in a dense half hour: first lines as titles, four venues spelled in two ways or missing."""
    k = F.col("doc_id")
    at = F.lit("2026-08-01 18:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(k * 7 % 31).cast("int"))
    hall = F.concat(F.lit("Зал "), F.element_at(F.array(*map(F.lit, ("опери", "балету", "драми", "цирку"))), (F.length("source") % 4 + 1).cast("int")))
    venue = F.when(k % 3 == 0, hall).when(k % 3 == 1, F.concat(F.upper(hall), F.lit(", вхід з двору")))
    return docs.where("text is not null").select(k.alias("ord"), F.substring_index("text", "\n", 1).alias("title"), at.alias("start_at"), venue.alias("venue"), F.md5("source").alias("group_key"))


@query(None)
def canonical_fuzzy_leader(spark, d):
    """Greedy leader clusters of all documents as listings, by title, time and venue, in the order of doc_id."""
    rows = listings(t(spark, d, "documents")).drop("group_key")
    return canonical.fuzzy_clusters(rows, "ord", "leader").select(F.col("ord").alias("doc_id"), "cluster")


@query(None)
def canonical_fuzzy_any(spark, d):
    """Greedy any-member clusters of all documents as listings, by title, time and venue, in the order of time, title, venue."""
    rows = listings(t(spark, d, "documents")).withColumn("id", F.col("ord")).withColumn("group_key", F.md5("title"))
    return entries.fuzzy(rows).select(F.col("ord").alias("doc_id"), F.sha2("cluster", 256).alias("cluster"))


@query("""SELECT o_custkey, day, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS prices, count(*) AS n_offers FROM (SELECT *, o_orderdate::DATE AS day FROM orders) GROUP BY o_custkey, day""")
def cluster_offers(spark, d):
    rows = t(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day"))
    return rows.agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("prices"), F.count("*").alias("n_offers"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS offer FROM orders")
def offer_numbers(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("offer"))


@query("SELECT count(*) AS clusters, count(*) FILTER (n >= 2) AS multi, sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM documents GROUP BY md5(lower(coalesce(text, ''))))")
def multi_source_count(spark, d):
    rows = t(spark, d, "documents").groupBy(F.md5(F.lower(F.coalesce("text", F.lit("")))).alias("k")).agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") >= 2).alias("multi"), F.sum("n").alias("n_rows"))


@query("""WITH seed AS (SELECT ts, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 1)
SELECT DISTINCT e.event_type || ':' || e.user_id AS group_key FROM events e, seed s WHERE e.ts BETWEEN s.ts - INTERVAL 6 HOUR AND s.ts + INTERVAL 6 HOUR""")
def related_keys_band(spark, d):
    events = t(spark, d, "events")
    seed = events.where("event_type = 'purchase'").agg(F.min(F.struct("ts", "event_id")).alias("s")).select(F.col("s.ts").alias("at"))
    near = events.join(F.broadcast(seed), (F.col("ts") >= F.col("at") - F.expr("INTERVAL 6 HOURS")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL 6 HOURS")))  # the seed is one row
    return near.select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("group_key")).distinct()


@query("""SELECT a.event_id AS event_id_a, b.event_id AS event_id_b FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id < b.event_id AND a.user_id <> b.user_id
AND b.ts BETWEEN a.ts - INTERVAL 1 MINUTE AND a.ts + INTERVAL 1 MINUTE""")
def duplicate_candidates_band(spark, d):
    rows = t(spark, d, "events").select("event_id", "event_type", "user_id", "ts")
    pairs = dedupe.band_pairs(rows, rows, "ts", 60, ["event_type"]).where("l.event_id < r.event_id and l.user_id <> r.user_id")
    return pairs.select(F.col("l.event_id").alias("event_id_a"), F.col("r.event_id").alias("event_id_b"))


@query(None)
def duplicate_candidates_fuzzy(spark, d):
    """Similar titles of different sources: first lines, all at one time, so that all are compared."""
    docs = t(spark, d, "documents").where("length(text) > 0")
    classes = docs.groupBy("source", F.substring_index("text", "\n", 1).alias("title")).agg(F.min("doc_id").alias("ord"))
    return canonical.title_duplicates(classes.withColumn("external_id", F.col("ord").cast("string")))


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))"


@query(f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
e AS (SELECT item_id, len(w) AS n, unnest(w) AS x FROM b), f AS (SELECT doc_id, len(w) AS m, unnest(w) AS x FROM d)
SELECT item_id, doc_id, count(*) AS shared FROM e JOIN f USING (x) GROUP BY item_id, doc_id, n, m HAVING count(*) >= 0.35 * least(n, m) AND least(n, m) >= 3""")
def token_overlap_pairs(spark, d):
    """Items of the benchmark and documents whose word sets share 35 % of the smaller set, which has three words at least."""
    words = lambda name, key: t(spark, d, name).select(key, F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9_]+)"), 1)).alias("w"))
    return dedupe.overlapping_sets(words("benchmark", "item_id"), "item_id", words("documents", "doc_id"), "doc_id", 0.35, 3)


# ---- de-duplication and sets ---------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_per_group(spark, d):
    return dedupe.keep_first(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins_by_key(spark, d):
    return dedupe.keep_last(t(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id"], "event_id")


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY first_id) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def ordered_distinct(spark, d):
    first = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ">").alias("kinds"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem")
def unordered_pair_dedupe(spark, d):
    return t(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("low"), F.greatest("l_partkey", "l_suppkey").alias("high")).distinct()


@query("SELECT 'customer' AS source, c_name AS name, c_nationkey AS nationkey FROM customer UNION ALL SELECT 'supplier', s_name, s_nationkey FROM supplier")
def union_of_sources(spark, d):
    a = t(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"))
    return a.unionByName(t(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey")))


# ---- joins with user state -----------------------------------------------------------------------------------------


@query("SELECT c_custkey, o.next_at, o.o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS next_at, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_custkey) o ON c_custkey = o_custkey")
def next_event_per_group(spark, d):
    later = t(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    first = later.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("n"))
    return t(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("n.o_orderdate").alias("next_at"), "n.o_orderkey")


@query("""WITH n AS (SELECT o_custkey, min(o_orderdate) AS start_at FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' GROUP BY o_custkey),
s AS (SELECT c_custkey, (c_custkey % 60 + 1) * INTERVAL 1 DAY AS lead_time, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '1997-12-30' END AS last FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, start_at, start_at - lead_time AS target FROM s JOIN n ON o_custkey = c_custkey WHERE start_at - lead_time <= TIMESTAMP '1998-01-01' AND (last IS NULL OR last < start_at - lead_time)""")
def due_reminders(spark, d):
    key = F.col("c_custkey")
    subscriptions = t(spark, d, "customer").select(
        key.alias("user_id"), key.alias("group_key"), (key % 5 != 0).alias("enabled"), ((key % 60 + 1) * 1440).cast("int").alias("notify_before_minutes"), F.when(key % 3 == 0, F.lit("1997-12-30").cast("timestamp_ntz")).alias("last_notified_at")
    )
    events = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_key"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("start_at"), F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("active").alias("status"))
    return jobs.due(subscriptions, events, "1998-01-01 00:00:00").select(F.col("user_id").alias("c_custkey"), "start_at", "target")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def favorites_semi_join(spark, d):
    keys = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""WITH c AS (SELECT o_orderdate::DATE AS day, list(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1) SELECT day, len(keys)::INT AS members FROM c WHERE list_has_any(keys, [1::BIGINT, 7, 13, 22, 101, 250])""")
def favorites_cluster_overlap(spark, d):
    mine = F.col("o_custkey").isin(1, 7, 13, 22, 101, 250)
    rows = t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.bool_or(mine).alias("met"), F.count_distinct("o_custkey").cast("int").alias("members"))
    return rows.where("met").select("day", "members")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def new_dimension_rows(spark, d):
    known = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t(spark, d, "orders").select("o_custkey").distinct().join(known, "o_custkey", "left_anti")


@query("""SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS favorite, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS reminded
FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'""")
def user_flags_join(spark, d):
    c = t(spark, d, "customer")
    a = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("a"))
    b = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("b"))
    rows = t(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return rows.join(a, F.col("o_custkey") == F.col("a"), "left").join(b, F.col("o_custkey") == F.col("b"), "left").select("o_orderkey", F.col("a").isNotNull().alias("favorite"), F.col("b").isNotNull().alias("reminded"))


@query("""SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15' GROUP BY user_id ORDER BY first_at, user_id""")
def alerts_since(spark, d):
    rows = t(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit(NOW).cast("timestamp_ntz")))
    return rows.groupBy("user_id").agg(F.min("ts").alias("first_at")).orderBy("first_at", "user_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-17')
SELECT event_id, strftime(ts, '%d.%m.%Y') || chr(10) || strftime(ts, '%H:%M') || ' ' || event_type AS line FROM r WHERE k = 1 ORDER BY ts, event_id LIMIT 15""")
def tomorrow_digest(spark, d):
    rows = t(spark, d, "events").where(timeutil.in_range(F.col("ts"), "2024-01-16", "2024-01-17")).select("event_id", "ts", "event_type", "user_id")
    rows = dedupe.keep_first(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).orderBy("ts", "event_id").limit(15)
    return rows.select("event_id", F.concat_ws("\n", F.date_format("ts", "dd.MM.yyyy"), F.concat_ws(" ", F.date_format("ts", "HH:mm"), "event_type")).alias("line"))


@query("""SELECT * FROM (SELECT event_type, n, count(*) OVER () - 3 AS more FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)) ORDER BY n DESC, event_type LIMIT 3""")
def topn_remainder(spark, d):
    per = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return per.withColumn("more", F.count("*").over(W.partitionBy()) - 3).orderBy(F.desc("n"), "event_type").limit(3)


# ---- health of sources ---------------------------------------------------------------------------------------------


def _runs(spark, d) -> DataFrame:
    daily = t(spark, d, "events").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy(F.col("event_type").alias("source"), F.date_trunc("day", "ts").alias("started_at")).agg(F.count("*").cast("int").alias("n"))
    status = F.when(F.pmod(F.dayofmonth("started_at") + F.length("source"), F.lit(6)) == 0, "error").otherwise("success")
    return daily.select("source", "started_at", status.alias("status"), F.when(F.col("source") == "click", F.when(F.dayofmonth("started_at") == 14, 1).otherwise(F.col("n") + 9)).otherwise(F.col("n")).alias("collected_count"))


_RUNS = """WITH daily AS (SELECT event_type AS source, date_trunc('day', ts)::TIMESTAMP AS started_at, count(*)::INT AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
runs AS (SELECT source, started_at, CASE WHEN (day(started_at) + length(source)) % 6 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN source = 'click' THEN CASE WHEN day(started_at) = 14 THEN 1 ELSE n + 9 END ELSE n END AS collected_count FROM daily),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC) AS k FROM runs), seven AS (SELECT * FROM l WHERE k <= 7),
good AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS g FROM seven WHERE status = 'success'),
base AS (SELECT s.source, count(*) AS n_runs, arg_min(s.status, s.k) AS last_status, arg_min(s.collected_count, s.k)::DOUBLE AS last_count,
  (SELECT median(collected_count) FROM good WHERE good.source = s.source AND g > 1)::DOUBLE AS median_collected FROM seven s GROUP BY s.source)"""
_STATUS = (
    _RUNS
    + """, up AS (SELECT event_type AS source, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' AND event_type <> 'signup') AS in_window, min(ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS next_event FROM events GROUP BY 1),
names AS (SELECT DISTINCT event_type AS source FROM events UNION ALL SELECT 'never-seen'),
j AS (SELECT names.source, n_runs, last_status, last_count, median_collected, next_event, coalesce(in_window, 0) AS in_window,
  last_status = 'success' AND last_count > 0 AND median_collected >= 5 AND last_count < 0.5 * median_collected AS dropped FROM names LEFT JOIN base USING (source) LEFT JOIN up USING (source)),
st AS (SELECT source, CASE WHEN n_runs IS NULL THEN 'unknown' WHEN last_status = 'error' THEN 'down' WHEN last_status = 'success' AND last_count = 0 THEN 'degraded' WHEN dropped THEN 'degraded'
  WHEN next_event IS NOT NULL AND in_window = 0 THEN 'quiet' WHEN n_runs < 3 THEN 'warming' ELSE 'healthy' END AS status, coalesce(last_status = 'error' OR dropped, FALSE) AS anomaly, last_count, median_collected FROM j)"""
)


def _statuses(spark, d) -> DataFrame:
    events = t(spark, d, "events")
    window = timeutil.in_range(F.col("ts"), DAY, "2024-01-22") & (F.col("event_type") != "signup")
    upcoming = events.groupBy(F.col("event_type").alias("source")).agg(F.count_if(window).alias("in_window"), F.min(F.when(F.col("ts") >= F.lit(DAY).cast("timestamp_ntz"), F.col("ts"))).alias("next_event"))
    names = events.select(F.col("event_type").alias("source")).distinct().union(spark.createDataFrame([("never-seen",)], "source string"))
    return health.status(names, _runs(spark, d), upcoming)


@query(_RUNS + " SELECT source, started_at, status, collected_count, k::INT AS rank FROM seven")
def latest_runs(spark, d):
    return dedupe.latest(_runs(spark, d), ["source"], [F.col("started_at").desc()], 7).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query(_RUNS + " SELECT source, n_runs::INT AS n_runs, last_status, last_count, median_collected FROM base")
def run_baseline_median(spark, d):
    return health.baselines(_runs(spark, d))


@query(_STATUS + " SELECT source, status, anomaly, last_count, median_collected FROM st")
def source_health_status(spark, d):
    return _statuses(spark, d).select("source", "status", "anomaly", "last_count", "median_collected")


@query(_STATUS + " SELECT CASE WHEN bool_or(status IN ('down', 'degraded')) THEN 'degraded' WHEN bool_or(status = 'unknown') THEN 'warming' ELSE 'healthy' END AS overall FROM st")
def overall_health(spark, d):
    return health.overall(_statuses(spark, d))


@query("SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22') AS in_window, min(ts) FILTER (ts >= TIMESTAMP '2024-01-15') AS next_at FROM events GROUP BY event_type")
def freshness_counts(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_if(timeutil.in_range(F.col("ts"), DAY, "2024-01-22")).alias("in_window"), F.min(F.when(F.col("ts") >= F.lit(DAY).cast("timestamp_ntz"), F.col("ts"))).alias("next_at"))


# ---- quality -------------------------------------------------------------------------------------------------------


def _batch(spark, d) -> DataFrame:
    k = F.col("page_id")
    return t(spark, d, "pages").select(
        k.alias("ord"),
        F.concat(F.lit("s"), F.expr("page_id div 3").cast("string")).alias("source"),
        F.when(k % 31 == 0, "").otherwise(k.cast("string")).alias("external_id"),
        F.when(k % 37 == 1, " ").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.when(k % 29 == 2, F.concat(F.lit("ftp://x/"), k.cast("string"))).when(k % 43 == 3, F.lit("")).otherwise(F.col("url")).alias("source_url"),
        F.when(k % 23 != 4, F.make_timestamp_ntz(F.lit(2024), F.lit(1), (k % 28 + 1).cast("int"), F.lit(12), F.lit(0), F.lit(0))).alias("start_at"),
        F.when(k % 7 == 5, F.lit("mailto:x")).otherwise(F.col("url")).alias("ticket_url"),
    )


_BATCH = """WITH b AS (SELECT 's' || (page_id // 3) AS source, CASE WHEN page_id % 31 = 0 THEN '' ELSE page_id::VARCHAR END AS external_id, CASE WHEN page_id % 37 = 1 THEN ' ' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
CASE WHEN page_id % 29 = 2 THEN 'ftp://x/' || page_id WHEN page_id % 43 = 3 THEN '' ELSE url END AS source_url, CASE WHEN page_id % 23 <> 4 THEN make_timestamp(2024, 1, page_id % 28 + 1, 12, 0, 0) END AS start_at,
CASE WHEN page_id % 7 = 5 THEN 'mailto:x' ELSE url END AS ticket_url FROM pages),
i AS (SELECT source, external_id, 'error' AS severity, 'missing_external_id' AS code FROM b WHERE trim(external_id) = '' UNION ALL SELECT source, external_id, 'error', 'missing_title' FROM b WHERE trim(title) = ''
UNION ALL SELECT source, external_id, 'error', 'missing_source_url' FROM b WHERE trim(source_url) = '' UNION ALL SELECT source, external_id, 'error', 'invalid_source_url' FROM b WHERE trim(source_url) <> '' AND NOT regexp_matches(source_url, '^(?i)https?:')
UNION ALL SELECT source, external_id, 'error', 'missing_start_at' FROM b WHERE start_at IS NULL UNION ALL SELECT source, external_id, 'error', 'past_event' FROM b WHERE start_at < TIMESTAMP '2024-01-15'
UNION ALL SELECT source, external_id, 'warning', 'invalid_ticket_url' FROM b WHERE ticket_url <> '' AND NOT regexp_matches(ticket_url, '^(?i)https?:'))"""


@query(_BATCH + " SELECT * FROM i")
def quality_issues(spark, d):
    return quality.issues(_batch(spark, d), NOW)


@query(_BATCH + " SELECT source, external_id FROM b WHERE source NOT IN (SELECT source FROM i WHERE severity = 'error')")
def quality_gate(spark, d):
    """Rows of sources (three pages each) without an error of any kind."""
    rows = _batch(spark, d)
    return quality.gate(rows, quality.issues(rows, NOW)).select("source", "external_id")


@query(_BATCH + " SELECT b.source, b.n AS collected, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings FROM (SELECT source, count(*) AS n FROM b GROUP BY 1) b LEFT JOIN (SELECT source, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM i GROUP BY 1) USING (source)")
def quality_summary(spark, d):
    rows = _batch(spark, d)
    return quality.summary(rows, quality.issues(rows, NOW))


_GENITIVE = "['" + "','".join(timeutil.MONTHS) + "']"


@query("SELECT o_orderkey, o_orderdate AS start_at, o_orderkey % 2 = 0 AS recovered FROM orders")
def missing_date_enrichment(spark, d):
    names = F.array(*map(F.lit, timeutil.MONTHS))
    at = F.col("o_orderdate")
    title = F.concat(F.lit("Show | "), F.dayofmonth(at).cast("string"), F.lit(" "), F.element_at(names, F.month(at)), F.lit(" "), F.year(at).cast("string"), F.lit(", "), F.date_format(at, "HH:mm"))
    # years before 2000 are outside of what the pattern takes, so titles say a hundred years later, and are moved back
    late = F.regexp_replace(title, r" (19|20)(\d\d), ", " 20$2, ")
    rows = t(spark, d, "orders").select("o_orderkey", at.alias("true_at"), late.alias("title"), F.when(F.col("o_orderkey") % 2 != 0, at).alias("start_at"))
    found = quality.with_recovered_dates(rows, "2000-01-01 00:00:00")
    moved = F.when(F.col("recovered") & (F.year("true_at") < 2000), F.col("start_at") - F.expr("INTERVAL 100 YEARS")).otherwise(F.col("start_at"))
    return found.select("o_orderkey", moved.alias("start_at"), "recovered")


# ---- snapshots -----------------------------------------------------------------------------------------------------


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    o = t(spark, d, "orders")
    k = F.col("o_orderkey")
    base = lambda late: o.where(k % 10 != (0 if not late else 1)).select(
        k.alias("external_id"), F.when(F.lit(late) & (k % 7 == 0), F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("category"),
        F.when(F.lit(late) & (k % 11 == 0), F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate")).alias("start_at"),
        F.when(F.lit(late) & (k % 13 == 0), F.lit("from 10")).otherwise(F.lit("10")).alias("price_text"),
        F.when(k % 3 == (0 if late else 1), F.concat(F.lit("http://t/"), k.cast("string"))).alias("ticket_url"), F.lit(None).cast("string").alias("venue"),
    )
    return base(False), base(True)


_SNAP = """WITH old AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS at, '10' AS price, CASE WHEN o_orderkey % 3 = 1 THEN 'http://t/' || o_orderkey END AS url FROM orders WHERE o_orderkey % 10 <> 0),
new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS title, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS at,
  CASE WHEN o_orderkey % 13 = 0 THEN 'from 10' ELSE '10' END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'http://t/' || o_orderkey END AS url FROM orders WHERE o_orderkey % 10 <> 1),
c AS (SELECT id, 'event_created' AS change_type, NULL::VARCHAR AS field_name, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM new WHERE id NOT IN (SELECT id FROM old)
UNION ALL SELECT n.id, 'field_changed', 'title', o.title, n.title FROM new n JOIN old o USING (id) WHERE o.title IS DISTINCT FROM n.title
UNION ALL SELECT n.id, 'date_changed', 'start_at', strftime(o.at, '%Y-%m-%d %H:%M:%S'), strftime(n.at, '%Y-%m-%d %H:%M:%S') FROM new n JOIN old o USING (id) WHERE o.at IS DISTINCT FROM n.at
UNION ALL SELECT n.id, 'price_changed', 'price_text', o.price, n.price FROM new n JOIN old o USING (id) WHERE o.price IS DISTINCT FROM n.price
UNION ALL SELECT n.id, CASE WHEN o.url IS NULL THEN 'ticket_sale_started' WHEN n.url IS NULL THEN 'ticket_link_removed' ELSE 'ticket_link_changed' END, 'ticket_url', o.url, n.url FROM new n JOIN old o USING (id) WHERE o.url IS DISTINCT FROM n.url)"""


@query(_SNAP + " SELECT id AS external_id, change_type, field_name, old_value, new_value FROM c")
def snapshot_changes(spark, d):
    return changes.changes(*_snapshots(spark, d), ["external_id"])


@query(_SNAP + " SELECT id AS external_id, change_type FROM c WHERE change_type LIKE 'ticket%'")
def change_types(spark, d):
    return changes.changes(*_snapshots(spark, d), ["external_id"], ("ticket_url",)).where("change_type like 'ticket%'").select("external_id", "change_type")


@query(_SNAP + " SELECT change_type, count(*) AS n FROM c GROUP BY change_type")
def change_counts(spark, d):
    return changes.changes(*_snapshots(spark, d), ["external_id"]).groupBy("change_type").agg(F.count("*").alias("n"))


@query(_SNAP + " SELECT coalesce(n.id, o.id) AS external_id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.id IS NOT NULL THEN n.at ELSE o.at END AS start_at, CASE WHEN n.id IS NOT NULL THEN n.url ELSE o.url END AS ticket_url FROM new n FULL JOIN old o USING (id)")
def snapshot_upsert(spark, d):
    return changes.upserted(*_snapshots(spark, d), ["external_id"]).select("external_id", "title", "start_at", "ticket_url")


@query(_islands_sql("user_id", 360) + """, k AS (SELECT *, md5(event_type || event_id) AS group_key FROM i), c AS (SELECT user_id, island, min(group_key) AS canonical_key FROM k GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT event_id, canonical_key, group_key <> canonical_key AS reassigned FROM k JOIN c USING (user_id, island)""")
def key_propagation(spark, d):
    rows = _event_clusters(spark, d, 6 * 3600, ["user_id"]).withColumn("group_key", F.md5(F.concat("event_type", F.col("event_id").cast("string"))))
    return changes.propagated_keys(rows).select("event_id", "canonical_key", "reassigned")


# ---- text, dates, pages --------------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || '|unknown-time|') AS group_key FROM documents WHERE text IS NOT NULL""")
def group_key_hash(spark, d):
    rows = t(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", text.group_key(F.substring_index("text", "\n", 1), F.lit(None).cast("timestamp"), F.lit(None).cast("string")).alias("group_key"))


@query("SELECT page_id, substr(sha256(url || '|' || page_id || '|' || '2024-01-15T00:00:00'), 1, 32) AS external_id FROM pages")
def external_id_hash(spark, d):
    return t(spark, d, "pages").select("page_id", text.external_id(F.col("url"), F.col("page_id").cast("string"), F.lit(NOW).cast("timestamp_ntz")).alias("external_id"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS norm FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("norm"))


@query("SELECT p_partkey, p_name AS title FROM part")
def strip_title_metadata(spark, d):
    """Titles with a date, the city and a price appended: stripped, the names are back."""
    k = F.col("p_partkey")
    suffix = F.when(k % 4 == 0, " 5 серпня 2026, 19:00").when(k % 4 == 1, " Тернопіль, Палац").when(k % 4 == 2, " від 250 грн за місце").otherwise(" квитки онлайн")
    return t(spark, d, "part").select("p_partkey", text.bare_title(F.concat("p_name", suffix)).alias("title"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE date_trunc('minute', o_orderdate + INTERVAL 10 YEAR) END::TIMESTAMP AS at FROM orders")
def parse_dates_multi(spark, d):
    """Dates in three dialects (month's name, numbers, ISO) and one that is none, parsed again."""
    at, k = F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS"), F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, timeutil.MONTHS)), F.month(at))
    worded = F.concat(F.dayofmonth(at).cast("string"), F.lit(" "), name, F.lit(" "), F.year(at).cast("string"), F.lit(", "), F.date_format(at, "HH:mm"))
    line = F.when(k % 4 == 0, worded).when(k % 4 == 1, F.date_format(at, "d.M.yyyy HH:mm")).when(k % 4 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm'Z'")).otherwise("31.2.2005 10:00")
    parsed = F.coalesce(timeutil.date_of_line(line, F.lit(2024)), timeutil.date_numeric(line), timeutil.iso_instant(line))
    return t(spark, d, "orders").select("o_orderkey", parsed.cast("timestamp_ntz").alias("at"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || ' грн' WHEN p_partkey % 3 = 1 THEN 'від ' || p_size || ' ₴' END AS price FROM part")
def extract_price(spark, d):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("Ціна "), size, F.lit("\xa0грн за місце"))).when(k % 3 == 1, F.concat(F.lit("квитки від "), size, F.lit(" ₴."))).otherwise(F.concat(F.lit("немає "), size))
    return t(spark, d, "part").select("p_partkey", text.price_of(F.regexp_replace(line, "\xa0", " ")).alias("price"))


@query("""SELECT doc_id, CASE WHEN x % 6 = 0 THEN 'standup' WHEN x % 6 = 1 THEN 'festival' WHEN x % 6 = 2 THEN 'theatre' WHEN x % 6 = 3 THEN 'concert' WHEN x % 6 = 4 THEN 'children' END AS category FROM (SELECT doc_id, doc_id AS x FROM documents)""")
def category_ladder(spark, d):
    words = F.array(*map(F.lit, ("Концерт і стендап", "Театр на фестивалі", "Вистава та концерт", "Великий КОНЦЕРТ для дітей", "Для дитини", "Лекція")))
    return t(spark, d, "documents").select("doc_id", text.category_of(F.element_at(words, (F.col("doc_id") % 6 + 1).cast("int"))).alias("category"))


@query("""WITH x AS (SELECT DISTINCT page_id, url, rtrim(split_part(part, '"', 1), ')],.;') AS h FROM (SELECT page_id, url, unnest(string_split(html, '<a href="')[2:]) AS part FROM pages))
SELECT page_id, CASE WHEN contains(h, '://') THEN h ELSE split_part(url, '://', 1) || '://' || split_part(split_part(url, '://', 2), '/', 1) || h END AS href FROM x""")
def page_links(spark, d):
    return page_sources.links(t(spark, d, "pages")).select("page_id", "href")


@query("SELECT split_part(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '/', 1) AS section, count(*) AS n FROM pages GROUP BY 1")
def link_paths(spark, d):
    return t(spark, d, "pages").groupBy(F.split_part(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), F.lit("/"), F.lit(1)).alias("section")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '') AS title, nullif(trim(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '\\s+', ' ', 'g')), '') AS heading FROM pages""")
def page_title(spark, d):
    return t(spark, d, "pages").select("page_id", page_sources.first_match(F.col("html"), "title").alias("title"), page_sources.first_match(F.col("html"), "h1").alias("heading"))


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:a|h1|title)[^>]*>([^<]+)<', 1)) AS x FROM pages) SELECT page_id, arg_max(x, (length(x), x)) AS title FROM c GROUP BY page_id""")
def longest_candidate(spark, d):
    found = F.regexp_extract_all("html", F.lit("<(?:a|h1|title)[^>]*>([^<]+)<"), 1)
    best = F.array_max(F.transform(found, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))
    return t(spark, d, "pages").select("page_id", best["x"].alias("title")).where("title is not null")


@query("""WITH l AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(html, '<[^>]*>'), lambda x: trim(x) <> '')) AS line, generate_subscripts(list_filter(regexp_split_to_array(html, '<[^>]*>'), lambda x: trim(x) <> ''), 1) AS pos FROM pages),
b AS (SELECT *, sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT page_id, block::BIGINT AS block, count(*) AS n_lines FROM b GROUP BY page_id, block""")
def page_blocks(spark, d):
    rows = t(spark, d, "pages").select("page_id", F.posexplode(F.filter(F.split("html", "<[^>]*>"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    return page_sources.heading_blocks(rows, "page_id", "pos", F.length("line") < 20).groupBy("page_id", "block").agg(F.count("*").alias("n_lines"))


@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before,
first_value(CASE WHEN role = 'assistant' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 19 FOLLOWING) AS after FROM conversations""")
def line_lookback(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    long = lambda role: F.when(F.col("role") == role, F.length("text").cast("long"))
    return t(spark, d, "conversations").select(
        "conv_id", "turn", F.last(long("user"), ignorenulls=True).over(w.rowsBetween(-6, -1)).alias("before"), F.first(long("assistant"), ignorenulls=True).over(w.rowsBetween(1, 19)).alias("after")
    )


@query("SELECT page_id, regexp_matches(url, '^(?i)https?:') AS valid, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM pages")
def url_scheme_check(spark, d):
    return t(spark, d, "pages").select("page_id", F.col("url").rlike(quality.HTTP).alias("valid"), F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_field_extract(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT (ts + INTERVAL 2 HOUR)::DATE AS day, strftime(min(ts + INTERVAL 2 HOUR), '%d.%m.%Y %H:%M') AS first, count(*) AS n FROM events GROUP BY 1")
def local_day_bucket(spark, d):
    local = timeutil.to_local(F.col("ts"))
    return t(spark, d, "events").groupBy(F.to_date(local).alias("day")).agg(F.date_format(F.min(local), "dd.MM.yyyy HH:mm").alias("first"), F.count("*").alias("n"))


@query(_BATCH + """, s AS (SELECT b.source, b.n AS collected, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings FROM (SELECT source, count(*) AS n FROM b GROUP BY 1) b LEFT JOIN (SELECT source, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM i GROUP BY 1) USING (source))
SELECT '{"collected":' || sum(collected)::BIGINT || ',"errors":' || sum(errors)::BIGINT || ',"warnings":' || sum(warnings)::BIGINT || ',"sources":[' || string_agg('{"source":"' || source || '","collected":' || collected || ',"errors":' || errors || ',"warnings":' || warnings || '}', ',' ORDER BY source) || ']}' AS report FROM s""")
def run_report_json(spark, d):
    rows = _batch(spark, d)
    found = quality.summary(rows, quality.issues(rows, NOW))
    return found.agg(F.to_json(F.struct(F.sum("collected").alias("collected"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.array_sort(F.collect_list(F.struct("source", "collected", "errors", "warnings"))).alias("sources"))).alias("report"))


# ---- lists, state and runs, as users ask for them -----------------------------------------------------------------------


def _snapshot(spark, d) -> DataFrame:
    """Stored events: a row per event of the table. Titles name a type and a user's hash, with variants in letters and case; every fifth type is cancelled."""
    k = F.col("event_id")
    owner = F.md5(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")))
    title = F.concat("event_type", F.lit(" "), owner)
    return t(spark, d, "events").select(
        k.alias("id"), owner.alias("group_key"), F.when(k % 5 == 2, F.concat(title, F.lit("q"))).when(k % 7 == 3, F.upper(title)).otherwise(title).alias("title"), F.col("event_type").alias("category"),
        F.when(k % 50 != 0, F.col("ts")).alias("start_at"), F.when(F.col("event_type") == "error", "cancelled").otherwise("active").alias("status"), F.concat((k % 3 * 100).cast("string"), F.lit(" грн")).alias("price_text"),
        F.when(k % 4 == 0, F.concat(F.lit("http://t/"), k.cast("string"))).alias("ticket_url"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), F.when(k % 2 == 0, F.concat(F.lit("Зал "), F.col("user_id").cast("string"))).alias("venue"), "user_id",
    )


_STORED = """WITH e AS (SELECT *, CASE WHEN id % 5 = 2 THEN base || 'q' WHEN id % 7 = 3 THEN upper(base) ELSE base END AS title FROM (SELECT event_id AS id, md5(event_type || ':' || user_id) AS group_key, event_type || ' ' || md5(event_type || ':' || user_id) AS base, event_type AS category,
CASE WHEN event_id % 50 <> 0 THEN ts END AS start_at, CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'active' END AS status, (event_id % 3 * 100) || ' грн' AS price_text, user_id FROM events))"""


def _occurrences_sql(where: str, rest: str, pick: str = "") -> str:
    """Occurrences of rows of e: stretches of a title's times (variants count as one) without a gap of over 15 minutes; undated rows alone."""
    return f"""{_STORED}{pick}, r AS (SELECT * FROM {'p' if pick else 'e'} WHERE status = 'active' AND {where}),
f AS (SELECT *, CASE WHEN start_at - lag(start_at) OVER (PARTITION BY base ORDER BY start_at, id) > INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS cut FROM r),
i AS (SELECT *, CASE WHEN start_at IS NULL THEN 'u' || id ELSE sum(cut) OVER (PARTITION BY base, start_at IS NULL ORDER BY start_at, id ROWS UNBOUNDED PRECEDING)::VARCHAR END AS island FROM f),
o AS (SELECT arg_min(title, (coalesce(start_at, TIMESTAMP '2000-01-01'), -length(title), id % 3, id)) AS title, any_value(group_key) AS group_key, any_value(category) AS category, min(start_at) AS start_at, min(id) AS low, string_agg(DISTINCT price_text, ', ' ORDER BY price_text) AS prices, count(*) AS n_rows FROM i GROUP BY base, island)
{rest}"""


_TOP = "SELECT title, start_at, prices, n_rows, greatest(total - 20, 0) AS more FROM (SELECT *, count(*) OVER () AS total FROM o) ORDER BY start_at NULLS LAST, title, low LIMIT 20"


def _listed(found: DataFrame, *more: str) -> DataFrame:
    return found.select("title", "start_at", F.array_join("prices", ", ").alias("prices"), "n_rows", *more)


@query(_occurrences_sql("start_at >= TIMESTAMP '2024-01-15 22:00:00' AND start_at < TIMESTAMP '2024-01-16 22:00:00'", _TOP))
def day_list(spark, d):
    """Tomorrow's occurrences as a user sees them: the local day, clusters, representatives, the top 20 and how many more."""
    return _listed(entries.day_list(_snapshot(spark, d), "2024-01-15 10:00:00", 1), "more")


@query(_occurrences_sql("start_at >= TIMESTAMP '2024-01-19 22:00:00' AND start_at < TIMESTAMP '2024-01-21 22:00:00'", _TOP))
def weekend_list(spark, d):
    return _listed(entries.weekend_list(_snapshot(spark, d), "2024-01-15 10:00:00"), "more")


@query(_occurrences_sql("start_at >= TIMESTAMP '2024-01-14 22:00:00' AND start_at < TIMESTAMP '2024-02-13 22:00:00'", _TOP.replace("FROM o)", "FROM o WHERE category = 'signup')")))
def category_list(spark, d):
    return _listed(entries.category_list(_snapshot(spark, d), "signup", "2024-01-15 10:00:00"), "more")


@query(_occurrences_sql("TRUE", _TOP.replace("greatest(total - 20, 0)", "0::BIGINT"), ", p AS (SELECT * FROM e WHERE status = 'active' AND contains(lower(title), 'purchase 1') AND (start_at IS NULL OR start_at >= TIMESTAMP '2024-01-14 22:00:00') ORDER BY start_at NULLS LAST, title, id LIMIT 60)"))
def search_list(spark, d):
    return _listed(entries.search_list(_snapshot(spark, d), "  Purchase   1", "2024-01-15 10:00:00"), "more")


_KEYS = ", k AS (SELECT DISTINCT c_custkey % 40 AS owner, md5(c_mktsegment || ':' || c_custkey) AS group_key FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'purchase' ELSE 'click' END AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0))"


def _keys(spark, d) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 2 == 0, "purchase").otherwise("click")
    return t(spark, d, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") % 40).alias("user_id"), F.md5(F.concat(kind, F.lit(":"), F.col("c_custkey").cast("string"))).alias("group_key")).distinct()


@query(_occurrences_sql("start_at >= TIMESTAMP '2024-01-20'", "SELECT owner AS user_id, title, start_at, prices, n_rows FROM o JOIN k USING (group_key)", "").replace(", r AS", f"{_KEYS}, r AS", 1))
def favorites_list(spark, d):
    return _listed(entries.kept_list(_snapshot(spark, d).drop("user_id"), _keys(spark, d), "2024-01-20 00:00:00"), "user_id")


@query(_occurrences_sql("start_at >= TIMESTAMP '2024-01-20'", "SELECT owner AS user_id, title, start_at, prices, n_rows FROM o JOIN k USING (group_key) WHERE owner % 4 <> 1", "").replace(", r AS", f"{_KEYS}, r AS", 1))
def reminders_list(spark, d):
    subscriptions = _keys(spark, d).withColumn("enabled", F.col("user_id") % 4 != 1)
    return _listed(entries.reminder_list(_snapshot(spark, d).drop("user_id"), subscriptions, "2024-01-20 00:00:00"), "user_id")


@query("""WITH f AS (SELECT c_custkey AS user_id, c_custkey % 7 AS g FROM customer WHERE c_custkey % 3 = 0), r AS (SELECT c_custkey AS user_id, c_custkey % 5 AS g FROM customer)
SELECT r.user_id, r.g::VARCHAR AS group_key, f.user_id IS NULL AS added FROM r LEFT JOIN f ON f.user_id = r.user_id AND f.g = r.g""")
def favorites_add(spark, d):
    """Requests to add favourites, with whether each is new."""
    c = t(spark, d, "customer")
    at = F.lit(NOW).cast("timestamp_ntz")
    pair = lambda n: c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % n).cast("string").alias("group_key"))
    return state.add_favorites(pair(7).where("user_id % 3 = 0").withColumn("created_at", at), pair(5).withColumn("at", at))[1].select("user_id", "group_key", "added")


@query("""WITH s AS (SELECT c_custkey AS user_id, (c_custkey % 7)::VARCHAR AS group_key, 60 AS lead_time, FALSE AS enabled, TIMESTAMP '2024-01-01' AS last FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT c_custkey AS user_id, (c_custkey % 5)::VARCHAR AS group_key, CASE WHEN c_custkey % 2 = 0 THEN 30 ELSE 1440 END AS lead_time FROM customer)
SELECT user_id, group_key, lead_time AS notify_before_minutes, enabled, last AS last_notified_at FROM s WHERE (user_id, group_key) NOT IN (SELECT user_id, group_key FROM r) UNION ALL SELECT user_id, group_key, lead_time, TRUE, NULL FROM r""")
def subscriptions_upsert(spark, d):
    """Subscriptions after requests: existing ones are enabled again with the lead asked for and no last notice."""
    c = t(spark, d, "customer")
    pair = lambda n: c.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % n).cast("string").alias("group_key"))
    old = pair(7).where("user_id % 3 = 0").withColumns({"notify_before_minutes": F.lit(60), "enabled": F.lit(False), "last_notified_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    return state.subscribe(old, pair(5).withColumn("notify_before_minutes", F.when(F.col("user_id") % 2 == 0, 30)))[0]


@query("""SELECT c_custkey AS telegram_id, CASE WHEN c_custkey % 4 = 0 THEN 'n' || c_custkey WHEN c_custkey % 3 = 0 THEN c_name END AS first_name, 'Europe/Kyiv' AS timezone FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0""")
def users_ensure(spark, d):
    """Users after requests: unknown ones are made, known ones take a new name that isn't empty."""
    k = F.col("c_custkey")
    users = t(spark, d, "customer").where(k % 3 == 0).select(k.alias("telegram_id"), F.col("c_name").alias("first_name"), F.lit("Europe/Kyiv").alias("timezone"))
    asked = t(spark, d, "customer").where(k % 2 == 0).select(k.alias("ord"), k.alias("telegram_id"), F.when(k % 4 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise("").alias("first_name"))
    off = users.select("telegram_id", *(F.lit(False).alias(c) for c in ("daily_tomorrow", "new_ticket_sales", "weekend_digest")), F.lit(18).alias("send_hour"))
    return state.ensure_users(users, off, asked)[0]


@query("""WITH r AS (SELECT event_type AS source, date_trunc('day', ts)::TIMESTAMP AS started_at, count(*)::INT AS n FROM events GROUP BY 1, 2)
SELECT source, started_at, CASE WHEN day(started_at) % 5 <> 0 THEN started_at + INTERVAL 1 HOUR END AS finished_at, CASE WHEN day(started_at) % 5 <> 0 THEN 'success' ELSE 'running' END AS status,
CASE WHEN day(started_at) % 5 <> 0 THEN n ELSE 0 END AS collected_count FROM r""")
def run_brackets(spark, d):
    """States of runs from their log: a row that opens and, but for every fifth day, one that closes."""
    daily = t(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg(F.count("*").cast("int").alias("n"))
    row = lambda at, status, n: daily.select(F.concat_ws("|", "source", "at").alias("run_id"), "source", at.alias("at"), F.lit(status).alias("status"), n.alias("collected_count"), F.lit(0).alias("changed_count"), F.lit(None).cast("string").alias("error_text"))
    log = row(F.col("at"), "running", F.lit(0)).unionByName(row(F.col("at") + F.expr("INTERVAL 1 HOUR"), "success", F.col("n")).where(F.dayofmonth("at") % 5 != 0))
    return state.run_states(log).select("source", "started_at", "finished_at", "status", "collected_count")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN make_timestamp(2031, 1 + p_partkey % 12, 1 + p_partkey % 24, p_partkey % 20, 30, 0) - INTERVAL (CASE WHEN p_partkey % 12 + 1 BETWEEN 4 AND 10 THEN 3 ELSE 2 END) HOUR END AS start_at,
p_partkey % 3 = 0 AS repaired FROM part""")
def stored_date_repair(spark, d):
    """Undated stored events whose titles have a local date get it, in UTC."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, timeutil.MONTHS)), (k % 12 + 1).cast("int"))
    dated = F.concat("p_name", F.lit(" "), (k % 24 + 1).cast("string"), F.lit(" "), name, F.lit(" 2031, "), (k % 20).cast("string"), F.lit(":30"))
    rows = t(spark, d, "part").select(k.alias("id"), F.lit("k").alias("group_key"), F.when(k % 3 != 1, dated).otherwise(F.col("p_name")).alias("title"), F.lit(None).cast("timestamp_ntz").alias("start_at"), F.when(k % 3 == 2, "cancelled").otherwise("active").alias("status"), F.lit(None).cast("string").alias("venue"))
    return state.repaired_dates(rows, NOW).select("id", "start_at", "repaired")


@query(_SNAP + """, a AS (SELECT id, TIMESTAMP '2024-01-01' + INTERVAL (id % 30) DAY AS at FROM c WHERE change_type = 'ticket_sale_started')
SELECT a.id AS event_id, o_orderpriority AS title, c_name AS venue, a.at AS detected_at FROM a JOIN orders ON o_orderkey = a.id LEFT JOIN customer ON c_custkey = o_custkey WHERE a.at >= TIMESTAMP '2024-01-15'""")
def ticket_alerts(spark, d):
    """Changes joined with their events and venues: ticket sales that started since a time, once per event."""
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("external_id") % 30).cast("int"))
    log = changes.changes(*_snapshots(spark, d), ["external_id"]).select(F.col("external_id").alias("event_id"), "change_type", at.alias("detected_at"))
    events = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("start_at"), F.lit("10").alias("price_text"), F.lit(None).cast("string").alias("ticket_url"), F.col("o_custkey").alias("venue_id"))
    venues = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return state.ticket_alerts(log, events, venues, NOW).select("event_id", "title", "venue", "detected_at")


@query(_islands_sql("user_id", 360) + """, k AS (SELECT *, md5(event_type || event_id) AS group_key FROM i), c AS (SELECT user_id, island, min(group_key) AS canonical_key FROM k GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT event_id, 'canonical_group_assigned' AS change_type, group_key AS old_value, canonical_key AS new_value FROM k JOIN c USING (user_id, island) WHERE group_key <> canonical_key""")
def key_assignment_log(spark, d):
    rows = _event_clusters(spark, d, 6 * 3600, ["user_id"]).withColumn("group_key", F.md5(F.concat("event_type", F.col("event_id").cast("string"))))
    return changes.key_log(changes.propagated_keys(rows), ["event_id"]).select("event_id", "change_type", "old_value", "new_value")


@query(_islands_sql("user_id, event_type", 15) + """ SELECT min(event_id) AS cluster, arg_min(event_id, (ts, event_id)) AS representative, min(ts) AS start_at, count(*) AS n_rows, count(DISTINCT event_id % 3) AS n_sources FROM i GROUP BY user_id, event_type, island""")
def cluster_representatives(spark, d):
    rows = _event_clusters(spark, d, 900, ["user_id", "event_type"]).withColumns({"id": F.col("event_id"), "source": (F.col("event_id") % 3).cast("string"), "title": F.col("event_type"), "start_at": F.col("ts"), "price_text": F.lit(None).cast("string"), "ticket_url": F.lit(None).cast("string")})
    best = canonical.representatives(rows.withColumn("cluster", F.concat_ws("|", "user_id", "cluster")), "any")
    return best.select(F.split_part("cluster", F.lit("|"), F.lit(2)).cast("long").alias("cluster"), F.col("event.event_id").alias("representative"), "start_at", "n_rows", "n_sources")


def _collection(spark, d) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    batch = _batch(spark, d).withColumns({"category": F.lit(None).cast("string"), "venue": F.lit(None).cast("string"), "price_text": F.lit("10 грн")})
    names = ("source", "external_id", "title", "category", "start_at", "venue", "price_text", "ticket_url", "source_url")
    return batch, batch.where("external_id like '%7'").select(*names).withColumn("price_text", F.lit("5 грн")), names


def _collected(spark, d) -> dict[str, DataFrame]:
    batch, old, names = _collection(spark, d)
    return entries.collected(old, batch.select("ord", *names), NOW, _runs(spark, d))


@query(_BATCH + """, good AS (SELECT * FROM b WHERE source NOT IN (SELECT source FROM i WHERE severity = 'error'))
SELECT count(*) FILTER (external_id NOT LIKE '%7') AS created, count(*) FILTER (external_id LIKE '%7') AS price_changed, (SELECT count(*) FROM b) AS collected, (SELECT count(*) FROM i WHERE severity = 'error') AS errors, FALSE AS passed FROM good""")
def collection_run(spark, d):
    """A whole collection over pages as a batch: what was created and changed, totals, and whether the run passes its gate."""
    run = _collected(spark, d)
    log = run["changes"].agg(F.count_if(F.col("change_type") == "event_created").alias("created"), F.count_if(F.col("change_type") == "price_changed").alias("price_changed"))
    return log.join(run["totals"].select("collected", "errors")).join(run["gate"].select("passed"))  # one row each


@query(_BATCH + """, p AS (SELECT source, count(*) AS collected FROM b GROUP BY 1),
e AS (SELECT source, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY 1),
n AS (SELECT DISTINCT source FROM b UNION ALL SELECT unnest(['empty', 'may be empty', 'broken'])),
x AS (SELECT source, coalesce(collected, 0) AS collected, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings,
  CASE WHEN source IN ('broken', 's2') THEN 'it broke' WHEN collected IS NULL AND source <> 'may be empty' THEN 'no rows' WHEN errors > 0 THEN errors || ' invalid rows' END AS error_text FROM n LEFT JOIN p USING (source) LEFT JOIN e USING (source))
SELECT *, CASE WHEN error_text IS NULL THEN collected ELSE 0 END AS changed, CASE WHEN error_text IS NULL THEN 'success' ELSE 'error' END AS status FROM x""")
def collection_sources(spark, d):
    """Runs of a collection's sources: read ones, one that gave nothing, one that may give nothing, two whose readers failed, one of them after it gave rows."""
    batch, old, names = _collection(spark, d)
    failures = spark.createDataFrame([("broken", "it broke"), ("s2", "it broke")], "source string, error_text string")
    asked = batch.select("source").distinct().unionByName(spark.createDataFrame([("empty",), ("may be empty",), ("broken",)], "source string"))
    run = entries.collected(old, batch.select("ord", *names), NOW, _runs(spark, d), names=asked, failures=failures, allow_empty=("may be empty",))
    return run["summary"].select("source", "collected", "errors", "warnings", "error_text", "changed", "status")


@query("""WITH u AS (SELECT page_id, rtrim(url, ')],.;') AS whole, rtrim(split_part(url, '#', 1), ')],.;') AS bare FROM pages WHERE contains(url, '/en/'))
SELECT page_id, bare AS href FROM u UNION SELECT page_id, whole FROM u""")
def path_link_counts(spark, d):
    """Links below /en/ of pages that end with their own address, as an anchor and in the text."""
    own = F.concat(F.lit("<p>See <a href='"), "url", F.lit("'>here</a>, "), "url", F.lit(").</p>"))
    return page_sources.path_links(t(spark, d, "pages").select("page_id", "url", F.concat("html", own).alias("body")), "/en/").select("page_id", "href")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN make_timestamp(2026, 9, 1 + page_id % 28, 19, 30, 0) ELSE make_timestamp(2026, 10, 1 + page_id % 28, 18, 0, 0) END AS start_at, 'Подія ' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN 'Зал ' || page_id || 'а' END AS venue FROM pages")
def card_events(spark, d):
    """Cards put into the table's pages, read back by two readers: catalogue cards on even pages, times on odd ones."""
    k = F.col("page_id").cast("string")
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    even = F.concat(F.lit('<div class="event-card"><h3>Подія '), k, F.lit('</h3><a href="/e/'), k, F.lit('">Купити</a> '), day, F.lit(" вересня 2026, 19:30 Тернопіль • Зал "), k, F.lit("а 200 грн</div>"))
    odd = F.concat(F.lit("<div><h3>Подія "), k, F.lit("</h3><p>Тернопіль</p><p><time datetime='2026-10-"), day, F.lit("T18:00:00+03:00'>18</time></p></div>"))
    card = F.when(F.col("page_id") % 2 == 0, even).otherwise(odd)
    rows = t(spark, d, "pages").select("page_id", "url", F.concat(F.regexp_replace("html", "</body>(?s).*", ""), card, F.lit("</body></html>")).alias("html"))
    now = "2026-01-01 00:00:00"
    both = cards.catalogue_cards(rows.where("page_id % 2 = 0"), now).unionByName(cards.time_cards(rows.where("page_id % 2 = 1"), now))
    return both.select("page_id", "start_at", "title", "venue")


@query("SELECT page_id, 'N' || page_id AS title, make_timestamp(2026, 9, 1 + page_id % 28, 16, 0, 0) AS start_at, (page_id % 9) || ' грн' AS price_text FROM pages")
def jsonld_of_pages(spark, d):
    """JSON-LD events put into the table's pages, nested in lists and graphs, read back."""
    k = F.col("page_id").cast("string")
    body = F.concat(F.lit('<script type="application/ld+json">{"@graph":[[{"@type":["MusicEvent"],"name":"N'), k, F.lit('","startDate":"2026-09-'), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit('T19:00:00+03:00","offers":[{"price":'), (F.col("page_id") % 9).cast("string"), F.lit("}]}]]}</script>"))
    rows = t(spark, d, "pages").select("page_id", "url", F.concat("html", body).alias("html"))
    return page_sources.jsonld_events(rows).select("page_id", "title", "start_at", "price_text")


# ---- streaming twins -----------------------------------------------------------------------------------------------

_SEEN = "SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS sightings FROM events GROUP BY user_id"


@query(_SEEN)
def first_last_seen(spark, d):
    return jobs.first_last_seen(t(spark, d, "events"), ["user_id"])


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, d):
    return jobs.tumbling_counts(t(spark, d, "events"))


@query(_islands_sql("user_id", 15).replace("> INTERVAL 15 MINUTE", ">= INTERVAL 15 MINUTE + INTERVAL 1 MICROSECOND") + " SELECT user_id, min(ts) AS session_start, count(*) AS n FROM i GROUP BY user_id, island")
def session_islands(spark, d):
    return jobs.sessions(t(spark, d, "events"), ["user_id"])
