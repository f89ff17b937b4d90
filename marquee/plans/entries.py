"""What users ask: lists of canonical occurrences by day, weekend, words, favourites and reminders; the run of a collection.

events: id, group_key, title, category, start_at (UTC), status, price_text, ticket_url, source, venue. A clustering takes such
rows and gives them a cluster; by default titles and venues are compared (fuzzy), where they are equal or nothing `equal` is
far cheaper. Lists show 20 at most and say how many more there are: that limit is the feature.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, timeutil
from ..operators import canonical, changes, dedupe, health, quality
from ..sources import cards, registry
from ..streaming import jobs
from ..tables import Scratch, shuffled

SHOWN, FOUND, DIGEST = 20, 20, 15
Clustering = Callable[[DataFrame], DataFrame]


def fuzzy(rows: DataFrame) -> DataFrame:
    """Greedy any-member clusters in the order of (start_at, title, venue, group_key); rows equal in these are one to it, however many."""
    empty = F.lit("")
    keys = {"_title": F.coalesce("title", empty), "_venue": F.coalesce("venue", empty), "_key": F.coalesce("group_key", empty)}
    given = rows.withColumns(keys)
    dated_key = F.concat_ws("\x01", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), *keys)
    given = given.withColumn("_ord", F.when(F.col("start_at").isNull(), F.concat(F.lit("undated:"), F.col("id").cast("string"))).otherwise(dated_key))
    dated = given.where("start_at is not null")
    nodes = dated.groupBy("_ord").agg(F.first("start_at").alias("start_at"), *(F.first(k).alias(c) for k, c in zip(keys, ("title", "venue", "group_key"), strict=True)))
    named = canonical.fuzzy_clusters(nodes, "_ord", "any", timed=True).select("_ord", "cluster")
    return given.join(shuffled(named), "_ord", "left").select(*rows.columns, F.coalesce("cluster", "_ord").alias("cluster"))


def equal(*keys: str) -> Clustering:
    """Clusters of rows with equal keys whose times chain within the tolerance; undated rows stand alone."""

    def clustering(rows: DataFrame) -> DataFrame:
        dated = canonical.clusters(rows.where("start_at is not null"), list(keys), "start_at", "id").withColumn("cluster", F.col("cluster").cast("string"))
        return dated.unionByName(rows.where("start_at is null").withColumn("cluster", F.concat(F.lit("undated:"), F.col("id").cast("string"))))

    return clustering


def occurrences(rows: DataFrame, clustering: Clustering = fuzzy) -> DataFrame:
    """One row per occurrence: its representative's columns, prices (distinct, sorted) and n_rows."""
    return _occurrences(clustering(rows), rows.columns)


def _occurrences(clustered: DataFrame, columns: list[str]) -> DataFrame:
    order = F.struct(F.col("start_at").isNull(), "start_at", -F.length(text.normalized(text.bare_title(F.coalesce("title", F.lit(""))))), "source", "id")
    price = F.nullif("price_text", F.lit(""))
    found = clustered.groupBy("cluster").agg(F.min_by(F.struct(*columns), order).alias("event"), F.array_sort(F.collect_set(price)).alias("prices"), F.count("*").alias("n_rows"))
    return found.select("cluster", "event.*", "prices", "n_rows")


def offers(clustered: DataFrame) -> DataFrame:
    """(cluster, source, ticket_url), distinct: where an occurrence's tickets are sold; clustered is what a clustering gives."""
    return clustered.where(F.coalesce("ticket_url", F.lit("")) != "").select("cluster", "source", "ticket_url").distinct()


def shown(found: DataFrame, limit: int = SHOWN, clustered: DataFrame | None = None) -> DataFrame:
    """The first `limit` occurrences by (start_at, title), with more, the number of others, and card, the text to show.

    With clustered, the rows the occurrences were made of, also keys: the group keys of those that are shown.
    """
    total = found.agg(F.count("*").alias("total"))
    top = found.orderBy(F.col("start_at").asc_nulls_last(), "title", "id").limit(limit).join(F.broadcast(total))  # one row
    top = top.withColumn("more", F.greatest(F.col("total") - limit, F.lit(0))).withColumn("card", text.event_card(F.col("title"), F.col("start_at"), F.col("venue"), F.col("prices"))).drop("total")
    if clustered is None:
        return top
    keys = clustered.select("cluster", "group_key").join(F.broadcast(top.select("cluster")), "cluster").groupBy("cluster").agg(F.array_sort(F.collect_set("group_key")).alias("keys"))  # limit rows
    return top.join(keys, "cluster")


def _list(rows: DataFrame, clustering: Clustering, kept: Column | None = None) -> DataFrame:
    clustered = clustering(rows)
    found = _occurrences(clustered, rows.columns)
    return shown(found if kept is None else found.where(kept), clustered=clustered).orderBy(F.col("start_at").asc_nulls_last(), "title", "id")


def between(events: DataFrame, start: Column, end: Column) -> DataFrame:
    return events.where((F.col("status") == "active") & (F.col("start_at") >= start.cast("timestamp_ntz")) & (F.col("start_at") < end.cast("timestamp_ntz")))


def day_list(events: DataFrame, now: str, days: int = 0, clustering: Clustering = fuzzy) -> DataFrame:
    """Occurrences of the local day `days` after now's (UTC)."""
    day = F.date_add(F.to_date(timeutil.to_local(F.lit(now).cast("timestamp_ntz"))), days)
    return _list(between(events, timeutil.to_utc(day), timeutil.to_utc(F.date_add(day, 1))), clustering)


def weekend_list(events: DataFrame, now: str, clustering: Clustering = fuzzy) -> DataFrame:
    """Occurrences of the next local Saturday and Sunday; on a Sunday of the next weekend."""
    saturday = timeutil.weekend_start(F.to_date(timeutil.to_local(F.lit(now).cast("timestamp_ntz"))))
    return _list(between(events, timeutil.to_utc(saturday), timeutil.to_utc(F.date_add(saturday, 2))), clustering)


def category_list(events: DataFrame, category: str, now: str, days: int = 30, clustering: Clustering = fuzzy) -> DataFrame:
    """Occurrences of a category in the local days from now's on; the representative's category counts, a missing one is the default."""
    day = F.to_date(timeutil.to_local(F.lit(now).cast("timestamp_ntz")))
    kept = F.coalesce(F.nullif("category", F.lit("")), F.lit(text.DEFAULT_CATEGORY)) == category
    return _list(between(events, timeutil.to_utc(day), timeutil.to_utc(F.date_add(day, days))), clustering, kept)


def search_list(events: DataFrame, words: str, now: str, limit: int = FOUND, clustering: Clustering = fuzzy) -> DataFrame:
    """Occurrences whose title holds the words: active, undated or from now's local day on; three times the limit of rows are clustered, then cut.

    Without words nothing is found. % and _ match as in LIKE.
    """
    day = timeutil.to_utc(F.to_date(timeutil.to_local(F.lit(now).cast("timestamp_ntz")))).cast("timestamp_ntz")
    rows = events.where((F.col("status") == "active") & text.like_literal(F.col("title"), words, wildcards=True) & (F.col("start_at").isNull() | (F.col("start_at") >= day)))
    rows = rows.orderBy(F.col("start_at").asc_nulls_last(), "title", "id").limit(3 * limit)
    return shown(occurrences(rows, clustering).orderBy(F.col("start_at").asc_nulls_last(), "title", "id").limit(limit))


def kept_list(events: DataFrame, keys: DataFrame, now: str, clustering: Clustering = fuzzy) -> DataFrame:
    """(user_id, occurrence columns): coming occurrences any of whose rows has a key of the user. keys: (user_id, group_key)."""
    rows = events.where((F.col("status") == "active") & (F.col("start_at") >= F.lit(now).cast("timestamp_ntz")))
    clustered = clustering(rows)
    hit = clustered.select("cluster", "group_key").distinct().join(shuffled(keys.select("user_id", "group_key").distinct()), "group_key").select("user_id", "cluster").distinct()
    return hit.join(shuffled(_occurrences(clustered, rows.columns)), "cluster")


def reminder_list(events: DataFrame, subscriptions: DataFrame, now: str, clustering: Clustering = fuzzy) -> DataFrame:
    """kept_list of the keys of enabled subscriptions."""
    return kept_list(events, subscriptions.where("enabled"), now, clustering)


def tomorrow_text(events: DataFrame, now: str) -> DataFrame:
    """One row: the digest of the next local day, the first DIGEST group keys by (start_at, id), or a line that says there are none."""
    day = F.date_add(F.to_date(timeutil.to_local(F.lit(now).cast("timestamp_ntz"))), 1)
    rows = dedupe.keep_first(between(events, timeutil.to_utc(day), timeutil.to_utc(F.date_add(day, 1))), ["group_key"], [F.col("start_at"), F.col("id")]).orderBy("start_at", "id").limit(DIGEST)
    given = lambda c, made: F.when(F.coalesce(c, F.lit("")) != "", made).otherwise("")
    line = F.concat(F.lit("🎟️ <b>"), "title", F.lit("</b> — "), F.date_format("start_at", "HH:mm"), given(F.col("price_text"), F.concat(F.lit(" · "), "price_text")), given(F.col("ticket_url"), F.concat(F.lit("\n🎫 "), "ticket_url")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_at", "id", line.alias("line")))), lambda x: x["line"]), "\n\n")
    none, some = "🌙 <b>Завтра в Тернополі</b>\n\nПоки що цікавих подій у базі немає.", "🌙 <b>Що цікавого завтра в Тернополі</b>\n\n"
    return rows.agg(body.alias("body"), F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.concat(F.lit(some), "body")).otherwise(none).alias("text"))


def read_sources(sources: list[registry.Source], pages: DataFrame, now: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(batch, failures): every production source's reader over the pages (page_id, url, html) below its address, each by itself.

    A reader that fails gives a row (source, error_text) of failures and no rows of the batch; the others go on. The batch has
    ord, by source, page and place, and source beside the columns of events. Each source's rows are a table of scratch.
    """
    spark, read, failed = pages.sparkSession, [], []
    for k, s in enumerate(s for s in sources if s.production):
        try:
            rows = s.read(pages.where(F.startswith("url", F.lit(s.base_url))), now)
            order = F.concat_ws("|", F.lit(f"{k:06d}"), *(F.lpad(F.col(c).cast("string"), 20, "0") for c in ("page_id", "pos")))
            read.append(scratch.cut(rows.select(order.alias("ord"), F.lit(s.name).alias("source"), *cards.EVENT), "source"))
        except Exception as e:  # whatever a reader raises is that source's failure alone
            failed.append((s.name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    failures = spark.createDataFrame(failed, "source string, error_text string")
    if not read:
        kinds = ", ".join(f"{c} {'timestamp_ntz' if c == 'start_at' else 'string'}" for c in ("ord", "source", *cards.EVENT))
        return spark.createDataFrame([], kinds), failures
    return functools.reduce(DataFrame.unionByName, read), failures


def collected(old: DataFrame, batch: DataFrame, now: str, runs: DataFrame, gated: bool = True, names: DataFrame | None = None, failures: DataFrame | None = None, allow_empty: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A collection: dates recovered from titles, rules, the gate, the next snapshot, its changes, duplicates, canonical keys, this run's rows, health and a report.

    batch: ord, source, external_id, title, category, start_at, venue, price_text, ticket_url, source_url; old: the snapshot of
    these columns but ord. names (source): all that should have been read, by default those of the batch; failures (source,
    error_text): readers that failed. A source that failed, that gave no rows without being in allow_empty, or that has an
    invalid row is an error run, and nothing of it is stored. Of equal ids of a source the last stays. Without gated (a single
    source) nothing is enriched or refused.
    """
    spark, at = batch.sparkSession, F.lit(now).cast("timestamp_ntz")
    rows = quality.with_recovered_dates(batch, now) if gated else batch.withColumn("recovered", F.lit(False))
    found = quality.issues(rows, now)
    failures = spark.createDataFrame([], "source string, error_text string") if failures is None else failures
    accepted = (quality.gate(rows, found) if gated else rows).join(failures.select("source"), "source", "left_anti")
    keys = ["source", "external_id"]
    fresh = dedupe.keep_last(accepted.select("ord", *old.columns), keys, "ord").select(*old.columns)
    log = changes.changes(old, fresh, keys)
    per = log.groupBy("source").agg(F.count("*").alias("changed"))
    names = rows.select("source").distinct() if names is None else names.select("source").distinct()
    summary = names.join(quality.summary(rows, found), "source", "left").join(per, "source", "left").join(rows.groupBy("source").agg(F.count_if("recovered").alias("repaired")), "source", "left")
    summary = summary.join(failures.groupBy("source").agg(F.min("error_text").alias("failure")), "source", "left").fillna(0, ["collected", "errors", "warnings", "changed", "repaired"])
    empty = (F.col("collected") == 0) & ~F.col("source").isin(*allow_empty)
    why = F.coalesce("failure", F.when(empty, F.lit("no rows")), F.when(F.lit(gated) & (F.col("errors") > 0), F.concat(F.col("errors").cast("string"), F.lit(" invalid rows"))))
    summary = summary.withColumn("error_text", why).withColumn("status", F.when(F.col("error_text").isNotNull(), "error").otherwise("success")).drop("failure")
    this = summary.select("source", at.alias("started_at"), "status", F.when(F.col("status") == "success", F.col("collected")).otherwise(0).cast("int").alias("collected_count"), F.col("changed").cast("int").alias("changed_count"), "error_text")
    snapshot = changes.upserted(old, fresh, keys)
    week = (F.col("start_at") >= at) & (F.col("start_at") < at + F.expr("INTERVAL 7 DAYS"))
    upcoming = snapshot.groupBy("source").agg(F.count_if(week).alias("in_window"), F.min(F.when(F.col("start_at") >= at, F.col("start_at"))).alias("next_event"))
    history = ("source", "started_at", "status", "collected_count")
    past = runs.select("source", F.col("started_at").cast("timestamp_ntz").alias("started_at"), *history[2:])
    states = health.status(summary.select("source"), past.unionByName(this.select(*history)), upcoming, allow_empty)
    totals = summary.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("collected", "changed", "errors", "warnings", "repaired")), F.count_if(F.col("status") == "error").alias("failed"))
    return {"snapshot": snapshot, "changes": log, "issues": found, "summary": summary, "totals": totals, "runs": this, "health": states, "gate": gate(summary, found, states), "accepted": accepted, "rows": rows}


def canonical_run(run: dict[str, DataFrame], scratch: Scratch) -> dict[str, DataFrame]:
    """What a collection's rows say of one another: duplicates (similar titles of two sources at one time), clusters (greedy leaders in the order of ord) and key_changes."""
    rows = scratch.cut(run["rows"].withColumn("group_key", text.group_key(F.col("title"), F.col("start_at"), F.col("venue"))), "rows")
    clusters = scratch.cut(canonical.fuzzy_clusters(rows, "ord", "leader", scratch=scratch), "clusters")
    log = changes.key_log(changes.propagated_keys(clusters), ["source", "external_id"])
    return {"duplicates": canonical.duplicate_candidates(rows), "clusters": clusters, "key_changes": log}


def report(run: dict[str, DataFrame], more: dict[str, DataFrame]) -> DataFrame:
    """One row (report: JSON): totals, quality, canonical counts, the number of duplicates, and a part for each source with its health."""
    sizes = more["clusters"].groupBy("cluster").agg(F.count_distinct("source").alias("sources"))
    counts = sizes.agg(F.count("*").alias("canonical_events"), F.count_if(F.col("sources") >= 2).alias("multi_source_events"))
    keyed, twice = more["key_changes"].agg(F.count("*").alias("group_key_changes")), more["duplicates"].agg(F.count("*").alias("duplicate_candidates"))
    each = run["summary"].join(run["health"].select("source", F.col("status").alias("health"), "anomaly", "next_event"), "source", "left")
    parts = each.agg(F.array_sort(F.collect_list(F.struct("source", "status", "collected", "changed", "errors", "warnings", "repaired", "error_text", "health"))).alias("sources"))  # a row for each source of the registry
    row = run["totals"].join(F.broadcast(counts)).join(F.broadcast(keyed)).join(F.broadcast(twice)).join(F.broadcast(health.overall(run["health"]))).join(F.broadcast(parts))  # one row each
    return row.select(F.to_json(F.struct(*row.columns)).alias("report"))


def gate(summary: DataFrame, found: DataFrame, states: DataFrame) -> DataFrame:
    """One row: whether a run passes, and why not: a failed source, an issue that is an error, or health that is degraded."""
    failed = summary.agg(F.coalesce(F.bool_or(F.col("status") == "error"), F.lit(False)).alias("failed_source"))
    wrong = found.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("quality_error"))
    ill = health.overall(states).select((F.col("overall") == "degraded").alias("degraded"))
    row = failed.join(F.broadcast(wrong)).join(F.broadcast(ill))  # one row each
    return row.withColumn("passed", ~(F.col("failed_source") | F.col("quality_error") | F.col("degraded")))


def require(gate_row: DataFrame) -> None:
    """Raise if the run's gate says that it doesn't pass."""
    row = gate_row.first()
    if not row["passed"]:
        raise RuntimeError("the run does not pass: " + ", ".join(k for k in ("failed_source", "quality_error", "degraded") if row[k]))


def due_texts(subscriptions: DataFrame, events: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """(user_id, group_key, target, chat_id, text) of reminders that are due; those of unknown users are left out."""
    rows = jobs.due(subscriptions, events, now).join(events.select(F.col("id").alias("event_id"), "venue", "price_text", "ticket_url"), "event_id")
    known = users.select(F.col("telegram_id").alias("user_id"), F.col("telegram_id").alias("chat_id")).where("chat_id is not null").distinct()
    made = text.reminder(F.col("title"), F.col("start_at"), F.col("venue"), F.col("price_text"), F.col("ticket_url"))
    return rows.join(known, "user_id").select("user_id", "group_key", "target", "chat_id", made.alias("text"))
