"""User state as snapshots: favourites, subscriptions, users and run brackets, changed by set operations.

Each function takes tables and requests and returns the next tables; nothing is updated in place. Users are known by
their telegram_id, favourites and subscriptions by (user_id, group_key).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, timeutil
from .canonical import TOLERANCE, by_any_member, same_occurrence
from .dedupe import band_pairs, keep_first

LEAD_MINUTES = 24 * 60


def related_keys(events: DataFrame, keys: DataFrame, seconds: int = TOLERANCE) -> DataFrame:
    """(asked, group_key): for every group_key of keys the keys of the occurrence that its earliest row belongs to, itself included.

    events: id, group_key, title, venue, start_at, status. Candidates are active rows within `seconds` of that row, inclusive,
    clustered by the any-member rule in the order of (start_at, id). A key without a row, or whose first row is undated or
    not active, has itself only. Memory: the rows within `seconds` of one row.
    """
    asked = keys.select(F.col("group_key").alias("asked")).where("asked is not null").distinct()
    order = F.struct(F.col("start_at").isNull(), "start_at", "id")
    seeds = events.join(asked, events.group_key == asked.asked, "left_semi").groupBy(F.col("group_key").alias("asked")).agg(F.min_by(F.struct("start_at", "id"), order).alias("seed"))
    seeds = seeds.select("asked", "seed.start_at", F.col("seed.id").alias("seed_id")).where("start_at is not null")
    near = band_pairs(seeds, events.where("status = 'active' and start_at is not null").select("id", "group_key", "title", "venue", "start_at"), "start_at", seconds)
    key = lambda c: text.normalized(c, compose=True)
    rows = near.select(
        "l.asked", "l.seed_id", "r.id", "r.group_key", F.col("r.start_at").cast("timestamp").alias("start_at"), key(text.bare_title(F.coalesce("r.title", F.lit("")))).alias("title_key"), key(F.coalesce("r.venue", F.lit(""))).alias("venue_key")
    )
    same = same_occurrence(seconds, keyed=True)

    def members(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_at", "id"], kind="stable")
        found = pd.Series(by_any_member(pdf.to_dict("records"), same), index=pdf.index)
        own = found[pdf["id"] == pdf["seed_id"]]
        return pdf[found.isin(own)][["asked", "group_key"]]

    found = rows.groupBy("asked").applyInPandas(members, "asked string, group_key string")
    return found.unionByName(asked.select("asked", F.col("asked").alias("group_key"))).distinct()


def _ranked(requests: DataFrame, keys: list[str], *order: str) -> tuple[DataFrame, list[str]]:
    """requests with _rank, the place of a request among those of its keys: by order, then ord if there is one, else as the rows come."""
    numbered = requests.withColumn("_n", F.col("ord") if "ord" in requests.columns else F.monotonically_increasing_id())
    return numbered.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order, "_n"))), requests.columns


def add_favorites(favorites: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next favourites, requests with added): favourites (user_id, group_key, created_at), requests (user_id, group_key, at[, ord]).

    A pair is added once, by its first request: the earliest, of equal times the one with the least ord.
    """
    keys = ["user_id", "group_key"]
    known = favorites.select(*keys).distinct().withColumn("_known", F.lit(True))
    ranked, columns = _ranked(requests, keys, "at")
    result = ranked.join(known, keys, "left").withColumn("added", (F.col("_rank") == 1) & F.col("_known").isNull())
    fresh = result.where("added").select(*keys, F.col("at").alias("created_at"))
    return favorites.unionByName(fresh), result.select(*columns, "added")


def _removed(table: DataFrame, requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    related = related_keys(events, requests)
    gone = requests.select("user_id", F.col("group_key").alias("asked")).distinct().join(related, "asked").select("user_id", "asked", "group_key")
    kept = table.join(gone, ["user_id", "group_key"], "left_anti")
    hit = gone.join(table.select("user_id", "group_key").distinct(), ["user_id", "group_key"]).select("user_id", F.col("asked").alias("group_key")).distinct().withColumn("removed", F.lit(True))
    return kept, requests.join(hit, ["user_id", "group_key"], "left").withColumn("removed", F.coalesce("removed", F.lit(False)))


def remove_favorites(favorites: DataFrame, requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next favourites, requests with removed): every key of the occurrence goes; removed tells whether there was one."""
    return _removed(favorites, requests, events)


def subscribe(subscriptions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next subscriptions, requests with created): an existing one is enabled again, with the lead asked for and no last notice.

    subscriptions (user_id, group_key, notify_before_minutes, enabled, last_notified_at), requests (user_id, group_key,
    notify_before_minutes, null for a day[, ord]). Of repeated requests the first may create, and the last one's lead counts.
    """
    keys = ["user_id", "group_key"]
    ranked, columns = _ranked(requests, keys)
    lead = F.max_by(F.coalesce("notify_before_minutes", F.lit(LEAD_MINUTES)), "_rank").alias("notify_before_minutes")
    asked = ranked.groupBy(*keys).agg(lead).withColumn("enabled", F.lit(True)).withColumn("last_notified_at", F.lit(None).cast("timestamp_ntz"))
    known = subscriptions.select(*keys).distinct().withColumn("_known", F.lit(True))
    following = subscriptions.join(asked.select(*keys), keys, "left_anti").unionByName(asked)
    result = ranked.join(known, keys, "left").withColumn("created", (F.col("_rank") == 1) & F.col("_known").isNull())
    return following, result.select(*columns, "created")


def subscribe_users(users: DataFrame, preferences: DataFrame, subscriptions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(next users, next preferences, next subscriptions, requests with created): subscribe, where unknown users are made."""
    asked = requests.select(F.lit(0).alias("ord"), F.col("user_id").alias("telegram_id"), F.lit(None).cast("string").alias("first_name"))
    return *ensure_users(users, preferences, asked), *subscribe(subscriptions, requests)


def unsubscribe(subscriptions: DataFrame, requests: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next subscriptions, requests with removed): as remove_favorites."""
    return _removed(subscriptions, requests, events)


def mark_notified(subscriptions: DataFrame, delivered: DataFrame, now: str) -> DataFrame:
    """subscriptions with last_notified_at = now where (user_id, group_key) was delivered."""
    keys = ["user_id", "group_key"]
    hit = delivered.select(*keys).distinct().withColumn("hit", F.lit(True))
    return subscriptions.join(hit, keys, "left").withColumn("last_notified_at", F.when(F.col("hit"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_notified_at"))).drop("hit")


def ensure_users(users: DataFrame, preferences: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next users, next preferences): users (telegram_id, first_name, timezone), requests (ord, telegram_id, first_name).

    An unknown user is made, with preferences that are all off; a known one takes a new name that isn't empty. Of repeated
    requests the last name that isn't empty counts.
    """
    name = F.max_by(F.nullif("first_name", F.lit("")), F.when(F.nullif("first_name", F.lit("")).isNotNull(), F.col("ord"))).alias("asked_name")
    asked = requests.where("telegram_id is not null").groupBy("telegram_id").agg(name)
    old = users.join(asked, "telegram_id", "left").select("telegram_id", F.coalesce("asked_name", "first_name").alias("first_name"), "timezone")
    new = asked.join(users.select("telegram_id"), "telegram_id", "left_anti")
    made = new.select("telegram_id", F.col("asked_name").alias("first_name"), F.lit(timeutil.ZONE).alias("timezone"))
    off = new.select("telegram_id", *(F.lit(False).alias(c) for c in ("daily_tomorrow", "new_ticket_sales", "weekend_digest")), F.lit(18).alias("send_hour"))
    return old.unionByName(made), preferences.unionByName(off)


def set_tomorrow_notices(users: DataFrame, preferences: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next users, next preferences) with daily_tomorrow as requests (ord, telegram_id, enabled) last ask."""
    users, preferences = ensure_users(users, preferences, requests.select("ord", "telegram_id", F.lit(None).cast("string").alias("first_name")))
    asked = requests.groupBy("telegram_id").agg(F.max_by("enabled", "ord").alias("asked"))
    return users, preferences.join(asked, "telegram_id", "left").withColumn("daily_tomorrow", F.coalesce("asked", "daily_tomorrow")).drop("asked")


def start_runs(sources: DataFrame, now: str) -> DataFrame:
    """Log rows that open a run of each source (name, base_url): run_id, source, at, status `running`, counts of 0."""
    at = F.lit(now).cast("timestamp_ntz")
    run = F.sha2(F.concat_ws("|", "name", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), 256)
    return sources.select(run.alias("run_id"), F.col("name").alias("source"), at.alias("at"), F.lit("running").alias("status"), F.lit(0).alias("collected_count"), F.lit(0).alias("changed_count"), F.lit(None).cast("string").alias("error_text"))


def finish_runs(runs: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Log rows that close runs (run_id, source): results (source, status, collected_count, changed_count, error_text)."""
    return runs.select("run_id", "source").join(results, "source").select("run_id", "source", F.lit(now).cast("timestamp_ntz").alias("at"), "status", "collected_count", "changed_count", "error_text")


def run_states(log: DataFrame) -> DataFrame:
    """The state of every run of an append-only log: its start, its end (null while it runs), and what its last row says."""
    last = F.max_by(F.struct("status", "collected_count", "changed_count", "error_text"), F.struct("at", F.col("status") != "running"))
    done = F.max(F.when(F.col("status") != "running", F.col("at")))
    return log.groupBy("run_id", "source").agg(F.min("at").alias("started_at"), done.alias("finished_at"), last.alias("last")).select("run_id", "source", "started_at", "finished_at", "last.*")


def repaired_dates(events: DataFrame, now: str) -> DataFrame:
    """events with repaired: undated active rows whose title has a date get it, as local time, in UTC, and a new group_key. now is UTC."""
    local = timeutil.to_local(F.lit(now).cast("timestamp_ntz"))
    found = timeutil.to_utc(timeutil.date_in_text(F.col("title"), local, F.year(local))).cast("timestamp_ntz")
    hit = F.coalesce((F.col("status") == "active") & F.col("start_at").isNull() & found.isNotNull(), F.lit(False))
    rows = events.withColumn("repaired", hit).withColumn("start_at", F.when(hit, found).otherwise(F.col("start_at")))
    return rows.withColumn("group_key", F.when(F.col("repaired"), text.group_key(F.col("title"), F.col("start_at"), F.col("venue"))).otherwise(F.col("group_key")))


def ticket_alerts(changes: DataFrame, events: DataFrame, venues: DataFrame, since: str) -> DataFrame:
    """(event_id, title, start_at, venue, price_text, ticket_url, detected_at): events whose ticket sale started since, by the first such change."""
    hits = changes.where((F.col("change_type") == "ticket_sale_started") & (F.col("detected_at") >= F.lit(since).cast("timestamp_ntz"))).select("event_id", "detected_at")
    first = keep_first(hits, ["event_id"], [F.col("detected_at")])
    rows = first.join(events.withColumnRenamed("id", "event_id"), "event_id").join(venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue")), "venue_id", "left")
    return rows.select("event_id", "title", "start_at", "venue", "price_text", "ticket_url", "detected_at")
