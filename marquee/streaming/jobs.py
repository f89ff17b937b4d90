"""Structured Streaming: first and last seen, tumbling counts, sessions, changes of snapshots, and due reminders with a ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import changes
from ..tables import Scratch
from . import messages


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over Parquet files that arrive in path."""
    return spark.readStream.schema(schema).parquet(path)


def first_last_seen(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Batch or stream (update mode): first and last time and number of sightings of each key."""
    return events.groupBy(*keys).agg(F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at"), F.count("*").alias("sightings"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Batch or stream: events of each type per window; late data up to `late` counts, state is dropped behind the watermark."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    out = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, keys: list[str], gap: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """Batch or stream: sessions of each key, ended by a gap."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", gap)
    return timed.groupBy(*keys, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def due(subscriptions: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """Reminders due at now: the next active event of each enabled subscription's group, within its lead time and not notified for it yet."""
    at = F.lit(now).cast("timestamp_ntz")
    following = events.where((F.col("status") == "active") & (F.col("start_at") >= at)).groupBy("group_key").agg(F.min(F.struct("start_at", "id", "title")).alias("next"))
    rows = subscriptions.where("enabled").join(following, "group_key")
    target = F.col("next.start_at") - F.make_dt_interval(mins=F.col("notify_before_minutes"))
    return rows.withColumn("target", target).where((F.col("target") <= at) & (F.col("last_notified_at").isNull() | (F.col("last_notified_at") < F.col("target")))).select(
        "user_id", "group_key", F.col("next.id").alias("event_id"), F.col("next.title").alias("title"), F.col("next.start_at").alias("start_at"), "target"
    )


KEYS = ["user_id", "group_key", "target"]
LEDGER = "user_id long, group_key string, target timestamp_ntz, error string, batch string, day date"


def _ledger(spark: SparkSession, ledger: str) -> DataFrame:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    return spark.read.schema(LEDGER).parquet(ledger) if at.getFileSystem(conf).exists(at) else spark.createDataFrame([], LEDGER)


def ledger_rows(spark: SparkSession, ledger: str, since: str | None = None) -> DataFrame:
    """(user_id, group_key, target, day) of what was sent, from the day of `since` on; empty before the first delivery. The ledger is parted by the target's day."""
    rows = _ledger(spark, ledger).where("error is null").select(*KEYS, "day")
    return rows.where(F.col("day") >= F.to_date(F.lit(since))) if since else rows


def deliver(batch: DataFrame, ledger: str, send: Callable[[Row], None] | None = None) -> None:
    """For foreachBatch: send what the ledger doesn't hold yet, each message by itself, and enter how it went.

    batch: (user_id, group_key, target, ...). send takes a row in a task and raises if it fails (see messages.sender). What was
    sent is entered whatever happens to others; once all is entered, a failure is a DeliveryError, and the next try sends the
    failed ones alone. A task that is lost before its rows are written sends its own again. Only the ledger's days from the
    batch's first target on are read.
    """
    spark, name = batch.sparkSession, uuid.uuid4().hex
    batch = batch.dropDuplicates(KEYS)
    first = batch.agg(F.min("target").alias("first")).first()["first"]
    if first is None:
        return
    fresh = batch.join(ledger_rows(spark, ledger, str(first)).select(*KEYS), KEYS, "left_anti")

    def tried(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            errors = []
            for row in pdf.to_dict("records"):
                try:
                    if send:
                        send(row)
                    errors.append(None)
                except Exception as e:  # any failure of one message is that message's alone
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[KEYS].assign(error=pd.Series(errors, index=pdf.index, dtype=object))

    results = fresh.mapInPandas(tried, "user_id long, group_key string, target timestamp_ntz, error string")
    results = results.withColumn("batch", F.lit(name)).withColumn("day", F.to_date("target"))
    results.write.mode("append").partitionBy("day").parquet(ledger)
    failed = _ledger(spark, ledger).where((F.col("batch") == name) & (F.col("day") >= F.to_date(F.lit(str(first)))) & F.col("error").isNotNull())
    if row := failed.agg(F.count("*").alias("n"), F.min("error").alias("error")).where("n > 0").first():
        raise messages.DeliveryError(f"{row['n']} messages failed, the first: {row['error']}")


def compact_ledger(spark: SparkSession, ledger: str, day: str, scratch: Scratch | None = None) -> None:
    """Rewrite one day of the ledger, of many small files, as one file of what was sent; not while a delivery writes that day."""
    with Scratch(spark, "ledger", scratch) as own:
        rows = own.cut(_ledger(spark, ledger).where((F.col("day") == F.to_date(F.lit(day))) & F.col("error").isNull()).dropDuplicates(KEYS), "day")
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(ledger)


def reminder_stream(ticks: DataFrame, due_at, ledger: str, checkpoint: str, send: Callable[[Row], None] | None = None, trigger: dict | None = None):
    """A stream of ticks (at: a time each): at every batch the reminders due at its last tick are delivered and marked.

    due_at(spark, now) gives the due rows from the tables as they are then. By default a batch starts each minute. A batch that
    fails ends the query; started again from its checkpoint it runs the same batch, and the ledger keeps what was marked.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = batch.agg(F.max("at").alias("at")).first()["at"]
        if last is not None:
            rows = due_at(batch.sparkSession, str(last))
            deliver(rows, ledger, send)

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def marked(subscriptions: DataFrame, ledger: DataFrame) -> DataFrame:
    """subscriptions whose last_notified_at is the ledger's last target of theirs, where that is later."""
    last = ledger.groupBy("user_id", "group_key").agg(F.max("target").alias("sent"))
    return subscriptions.join(last, ["user_id", "group_key"], "left").withColumn("last_notified_at", F.greatest("last_notified_at", "sent")).drop("sent")


CHANGE = "change_type string, field_name string, old_value string, new_value string, ord long, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"


def change_stream(rows: DataFrame, keys: list[str], tracked: tuple[str, ...] = changes.TRACKED) -> DataFrame:
    """Stream of (keys, CHANGE): what changes.changes says of one snapshot after another, and a row `seen` of each key that a batch holds.

    rows: keys, tracked fields, ord (the snapshot's number) and seen_at, from a stream. The last row of each key is its state.
    Rows of a batch are taken in the order of ord; a row whose ord is not above the state's is late and changes nothing but the
    first time its key was seen. Of rows of one key and ord the first by its fields counts. A key's rows of one batch are in
    memory one after the other; keys may be null.
    """
    fields = list(tracked)
    given = rows.select(*keys, *(F.col(c).cast("string").alias(c) for c in fields), "ord", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"))

    def kind(field: str, old: str | None, new: str | None) -> str:
        if field == "ticket_url":
            return "ticket_sale_started" if not old and new else "ticket_link_removed" if old and not new else "ticket_link_changed"
        return {"price_text": "price_changed", "start_at": "date_changed"}.get(field, "field_changed")

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, first_seen, last_seen, number = ([*state.get[: len(fields)]], *state.get[len(fields) :]) if state.exists else (None, None, None, None)
        out = []
        batch = pd.concat(list(parts))
        batch = batch.assign(**{c: batch[c].astype(object).where(batch[c].notna(), None) for c in fields})
        for row in sorted(batch.to_dict("records"), key=lambda r: (r["ord"], [(r[c] is None, r[c] or "") for c in fields])):
            seen = row["seen_at"].to_pydatetime()
            first_seen = seen if first_seen is None else min(first_seen, seen)
            if number is not None and row["ord"] <= number:
                continue
            last_seen = seen if last_seen is None else max(last_seen, seen)
            now = [row[c] for c in fields]
            if last is None:
                out.append(("event_created", None, None, None, row["ord"]))
            else:
                out += [(kind(c, a, b), c, a, b, row["ord"]) for c, a, b in zip(fields, last, now, strict=True) if a != b]
            last, number = now, row["ord"]
        state.update((*last, first_seen, last_seen, number))
        out.append(("seen", None, None, None, number))
        found = pd.DataFrame(out, columns=["change_type", "field_name", "old_value", "new_value", "ord"]).assign(first_seen_at=first_seen, last_seen_at=last_seen)
        for name, value in zip(keys[::-1], key[::-1], strict=True):
            found.insert(0, name, value)
        yield found

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), CHANGE])
    held = ", ".join([*(f"`{c}` string" for c in fields), "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, ord long"])
    return given.groupBy(*keys).applyInPandasWithState(follow, schema, held, "append", GroupStateTimeout.NoTimeout)
