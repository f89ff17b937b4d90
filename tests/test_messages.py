"""Messages through the sender, the sink of batches and streams, and the ledger."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marquee.operators import state
from marquee.streaming import jobs, messages
from tests.answering import answering

AT = datetime(2026, 8, 16, 12)
ROWS = "user_id long, group_key string, target timestamp_ntz, chat_id long, text string"


def due(spark, n=4):
    return spark.createDataFrame([(k, f"g{k}", AT, 10_000_000_000 + k, f"<b>T{k}</b>") for k in range(n)], ROWS).repartition(2)


def test_sender(spark):
    with answering(fails={2}, rejects={3}) as (url, calls):
        messages.post(url, "t", 5, "x")
        for match in ("500", "rejected"):
            with pytest.raises(messages.DeliveryError, match=match):
                messages.post(url, "t", 5, "x")
        assert calls == [5, 5, 5]
    with pytest.raises(messages.DeliveryError, match="no answer"):
        messages.post("http://127.0.0.1:9", "t", 5, "x")
    with pytest.raises(ValueError, match="token"):
        messages.sender("http://x", "")


def test_a_later_failure_keeps_the_marks_of_what_was_sent(spark, tmp_path):
    """Of two messages the second fails: the first is marked, the next try sends the second alone, a third try nothing."""
    ledger = f"file://{tmp_path}/ledger"
    with answering(fails={2}) as (url, calls):
        with pytest.raises(messages.DeliveryError, match="1 messages failed, the first: DeliveryError: HTTP status 500"):
            jobs.deliver(due(spark, 2), ledger, messages.sender(url, "t"))
        sent = [r.user_id for r in jobs.ledger_rows(spark, ledger).collect()]
        assert [10_000_000_000 + k for k in sent] == calls[:1]
        jobs.deliver(due(spark, 2), ledger, messages.sender(url, "t"))
        jobs.deliver(due(spark, 2), ledger, messages.sender(url, "t"))
        assert len(calls) == 3 and calls[2] == calls[1]
    jobs.compact_ledger(spark, ledger, "2026-08-16")
    assert sorted(r.user_id for r in jobs.ledger_rows(spark, ledger).collect()) == [0, 1]
    assert spark.read.parquet(ledger).select(F.input_file_name()).distinct().count() == 1
    jobs.deliver(due(spark, 0), ledger)
    jobs.deliver(due(spark, 3), ledger)
    assert jobs.ledger_rows(spark, ledger, "2026-08-16").count() == 3 and jobs.ledger_rows(spark, ledger, "2026-08-17").count() == 0


def test_batches_through_the_sink(spark, tmp_path):
    spark.dataSource.register(messages.Messages)
    marks = f"file://{tmp_path}/marks"
    rows = due(spark)
    write = lambda url: messages.unsent(spark, rows, marks).write.format("messages").options(endpoint=url, token="t", marks=marks).mode("append").save()
    with answering(rejects={3}) as (url, calls):
        with pytest.raises(Exception, match="1 messages failed"):
            write(url)
        assert len(calls) == 4 and messages.unsent(spark, rows, marks).count() == 1
        write(url)
        write(url)
        assert len(calls) == 5 and calls[4] == calls[2] and messages.unsent(spark, rows, marks).count() == 0
    with pytest.raises(Exception, match="missing: token, text"):
        rows.drop("text").write.format("messages").options(endpoint="http://x", marks=marks).mode("append").save()


def test_streams_through_the_sink(spark, tmp_path):
    spark.dataSource.register(messages.Messages)
    due(spark, 3).write.parquet(f"{tmp_path}/due")
    stream = jobs.stream_of(spark, f"{tmp_path}/due", ROWS)
    with answering() as (url, calls):
        run = lambda: stream.writeStream.format("messages").options(endpoint=url, token="t", marks=f"file://{tmp_path}/marks", checkpointLocation=f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
        run()
        run()
        assert sorted(calls) == [10_000_000_000 + k for k in range(3)]
    assert messages.unsent(spark, due(spark, 5), f"file://{tmp_path}/marks").count() == 2


def test_repeated_requests(spark):
    at = datetime(2026, 8, 15)
    asked = spark.createDataFrame([(1, 5, "a", at), (2, 5, "a", at), (3, 5, "b", at), (4, 6, "a", at)], "ord int, user_id long, group_key string, at timestamp_ntz")
    old = spark.createDataFrame([(6, "a", at)], "user_id long, group_key string, created_at timestamp_ntz")
    following, result = state.add_favorites(old, asked)
    assert {r.ord: r.added for r in result.collect()} == {1: True, 2: False, 3: True, 4: False} and following.count() == 3
    none = spark.createDataFrame([], "user_id long, group_key string, notify_before_minutes int, enabled boolean, last_notified_at timestamp_ntz")
    leads = spark.createDataFrame([(1, 5, "a", 1440), (2, 5, "a", 30), (3, 7, "a", None)], "ord int, user_id long, group_key string, notify_before_minutes int")
    users = spark.createDataFrame([(5, "A", "Europe/Kyiv")], "telegram_id long, first_name string, timezone string")
    off = spark.createDataFrame([(5, False, False, False, 18)], "telegram_id long, daily_tomorrow boolean, new_ticket_sales boolean, weekend_digest boolean, send_hour int")
    next_users, next_off, following, result = state.subscribe_users(users, off, none, leads)
    assert {r.user_id: r.notify_before_minutes for r in following.collect()} == {5: 30, 7: 1440}
    assert {r.ord: r.created for r in result.collect()} == {1: True, 2: False, 3: True}
    assert {r.telegram_id for r in next_users.collect()} == {5, 7} == {r.telegram_id for r in next_off.collect()}
