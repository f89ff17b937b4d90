"""User state, lists, collections and the reminder stream on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.operators import canonical, changes, dedupe, state
from marquee.plans import entries
from marquee.streaming import jobs, messages
from tests.answering import answering

NOW = "2026-08-15 09:00:00"
EVENTS = "id long, group_key string, title string, category string, start_at timestamp_ntz, status string, price_text string, ticket_url string, source string, venue string"
FAVORITES = "user_id long, group_key string, created_at timestamp_ntz"
SUBSCRIPTIONS = "user_id long, group_key string, notify_before_minutes int, enabled boolean, last_notified_at timestamp_ntz"
AT = datetime(2026, 8, 16, 16)


def stored(spark, *rows):
    """Rows of (id, group_key, title, start_at) with what differs from the defaults."""
    base = {"category": None, "status": "active", "price_text": None, "ticket_url": None, "source": "s", "venue": None}
    names = [c.split()[0] for c in EVENTS.split(", ")]
    made = [base | dict(zip(("id", "group_key", "title", "start_at"), r[:4], strict=True)) | (r[4] if len(r) > 4 else {}) for r in rows]
    return spark.createDataFrame([tuple(m[c] for c in names) for m in made], EVENTS)


def test_related_keys(spark):
    events = stored(
        spark, (1, "a", "Гурт Океан Ельзи тур", AT), (2, "b", "гурт океан ельзи: тур", AT + timedelta(minutes=15)), (3, "c", "Гурт Океан Ельзи тур", AT + timedelta(minutes=16)),
        (4, "d", "Лекція", AT), (5, "e", "Гурт Океан Ельзи тур", None), (6, "f", "Гурт Океан Ельзи тур", AT, {"status": "cancelled"}), (7, "a", "Гурт Океан Ельзи тур", AT + timedelta(days=3)),
    )
    asked = spark.createDataFrame([("a",), ("d",), ("e",), ("f",), ("none",), (None,), ("a",)], "group_key string")
    got = {}
    for r in state.related_keys(events, asked).collect():
        got.setdefault(r.asked, set()).add(r.group_key)
    assert got == {"a": {"a", "b"}, "d": {"d"}, "e": {"e"}, "f": {"f"}, "none": {"none"}}


def test_favorites(spark):
    at = datetime(2026, 8, 15)
    big = 6_000_000_000
    old = spark.createDataFrame([(big, "a", at), (1, "a", at)], FAVORITES)
    asked = spark.createDataFrame([(big, "a", at), (big, "b", at), (big, "b", at + timedelta(1))], "user_id long, group_key string, at timestamp_ntz")
    following, result = state.add_favorites(old, asked)
    assert sorted((r.group_key, r.added) for r in result.collect()) == [("a", False), ("b", False), ("b", True)] and following.count() == 3
    events = stored(spark, (1, "a", "Концерт", AT), (2, "b", "Концерт", AT))
    remove = spark.createDataFrame([(big, "b"), (2, "a")], "user_id long, group_key string")
    left, result = state.remove_favorites(following, remove, events)
    assert [(r.user_id, r.group_key) for r in left.collect()] == [(1, "a")]
    assert {(r.user_id, r.removed) for r in result.collect()} == {(big, True), (2, False)}


def test_subscriptions_and_users(spark):
    old = spark.createDataFrame([(1, "a", 60, False, datetime(2026, 8, 1)), (1, "b", 60, True, None)], SUBSCRIPTIONS)
    asked = spark.createDataFrame([(1, "a", None), (2, "a", 30)], "user_id long, group_key string, notify_before_minutes int")
    following, result = state.subscribe(old, asked)
    got = {(r.user_id, r.group_key): (r.notify_before_minutes, r.enabled, r.last_notified_at) for r in following.collect()}
    assert got == {(1, "a"): (1440, True, None), (1, "b"): (60, True, None), (2, "a"): (30, True, None)}
    assert {(r.user_id, r.created) for r in result.collect()} == {(1, False), (2, True)}
    left, result = state.unsubscribe(following, spark.createDataFrame([(1, "a"), (3, "a")], "user_id long, group_key string"), stored(spark, (1, "a", "X Y", AT), (2, "b", "X Y", AT)))
    assert [(r.user_id, r.group_key) for r in left.collect()] == [(2, "a")] and {(r.user_id, r.removed) for r in result.collect()} == {(1, True), (3, False)}
    marked = state.mark_notified(following, spark.createDataFrame([(2, "a")], "user_id long, group_key string"), NOW)
    assert {r.user_id for r in marked.where("last_notified_at is not null").collect()} == {2}

    users = spark.createDataFrame([(1, "A", "Europe/Kyiv"), (2, "B", "UTC")], "telegram_id long, first_name string, timezone string")
    prefs = spark.createDataFrame([(1, False, False, False, 18), (2, True, False, False, 18)], "telegram_id long, daily_tomorrow boolean, new_ticket_sales boolean, weekend_digest boolean, send_hour int")
    next_users, next_prefs = state.ensure_users(users, prefs, spark.createDataFrame([(1, 1, "A2"), (2, 1, ""), (3, 3, None), (4, 2, None)], "ord int, telegram_id long, first_name string"))
    assert {(r.telegram_id, r.first_name, r.timezone) for r in next_users.collect()} == {(1, "A2", "Europe/Kyiv"), (2, "B", "UTC"), (3, None, "Europe/Kyiv")} and next_prefs.count() == 3
    _, asked = state.set_tomorrow_notices(users, prefs, spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 2, False), (4, 9, True)], "ord int, telegram_id long, enabled boolean"))
    assert {(r.telegram_id, r.daily_tomorrow) for r in asked.collect()} == {(1, True), (2, False), (9, True)}


def test_run_brackets(spark):
    sources = spark.createDataFrame([("a", "u"), ("b", "v")], "name string, base_url string")
    opened = state.start_runs(sources, NOW)
    closed = state.finish_runs(opened, spark.createDataFrame([("a", "success", 5, 2, None)], "source string, status string, collected_count int, changed_count int, error_text string"), "2026-08-15 09:05:00")
    got = {r.source: (r.status, r.collected_count, r.finished_at) for r in state.run_states(opened.unionByName(closed)).collect()}
    assert got == {"a": ("success", 5, datetime(2026, 8, 15, 9, 5)), "b": ("running", 0, None)}


def test_repaired_dates(spark):
    events = stored(spark, (1, "x", "Гурт 5 вересня 2026, 19:00", None), (2, "x", "Гурт", None), (3, "x", "Гурт 5 вересня 19:00", None, {"status": "cancelled"}), (4, "x", "Шоу 3 січня 18:00", None))
    got = {r.id: r for r in state.repaired_dates(events, NOW).collect()}
    assert (got[1].start_at, got[1].repaired, got[4].start_at) == (datetime(2026, 9, 5, 16), True, datetime(2027, 1, 3, 16))
    assert got[1].group_key != "x" and got[2].group_key == got[3].group_key == "x" and not got[2].repaired and not got[3].repaired


def test_lists(spark):
    events = stored(
        spark, (1, "a", "Гурт Океан Ельзи", datetime(2026, 8, 15, 16), {"price_text": "300 грн", "ticket_url": "u1"}), (2, "b", "Гурт Океан Ельзи 15 серпня 2026", datetime(2026, 8, 15, 16, 10), {"price_text": "250 грн", "source": "t", "category": "concert"}),
        (3, "c", "Нічна подія", datetime(2026, 8, 15, 21, 30)), (4, "d", "Ранкова", datetime(2026, 8, 14, 20, 59)), (5, "e", "Скасована", AT, {"status": "cancelled"}), (6, "f", "Недільна", AT), (7, "g", "Без дати океан", None),
    )
    today = entries.day_list(events, NOW).collect()
    assert [(r.title, r.n_rows, r.prices, r.more) for r in today] == [("Гурт Океан Ельзи", 2, ["250 грн", "300 грн"], 0)]
    assert "🕐 19:00" in today[0].card and "250 грн, 300 грн" in today[0].card and sorted(today[0]["keys"]) == ["a", "b"]
    assert [r.title for r in entries.day_list(events, NOW, 1).collect()] == ["Нічна подія", "Недільна"]
    assert [r.title for r in entries.weekend_list(events, NOW).collect()] == ["Гурт Океан Ельзи", "Нічна подія", "Недільна"]
    assert [r.title for r in entries.search_list(events, "  ОКЕАН ", NOW).collect()] == ["Гурт Океан Ельзи", "Без дати океан"]
    assert entries.search_list(events, "  ", NOW).count() == 0
    assert [r.title for r in entries.category_list(events, "Інше", NOW).collect()] == ["Гурт Океан Ельзи", "Нічна подія", "Недільна"]
    keys = spark.createDataFrame([(7, "b", True), (8, "f", False), (9, "zz", True)], "user_id long, group_key string, enabled boolean")
    assert [(r.user_id, r.title) for r in entries.kept_list(events, keys, NOW).orderBy("user_id").collect()] == [(7, "Гурт Океан Ельзи"), (8, "Недільна")]
    assert [r.user_id for r in entries.reminder_list(events, keys, NOW).collect()] == [7]
    many = stored(spark, *((k, f"k{k}", f"подія номер {k}", datetime(2026, 8, 15, 12) + timedelta(minutes=20 * (k % 9))) for k in range(25)))
    got = entries.day_list(many, NOW, clustering=entries.equal("title")).collect()
    assert len(got) == 20 and {r.more for r in got} == {5}


def test_digest_text(spark):
    events = stored(spark, (2, "a", "Друга", AT, {"price_text": "5 грн", "ticket_url": "http://u"}), (1, "b", "Перша", AT), (3, "a", "Друга ще", AT + timedelta(hours=1)))
    assert entries.tomorrow_text(events, NOW).first().text == "🌙 <b>Що цікавого завтра в Тернополі</b>\n\n🎟️ <b>Перша</b> — 16:00\n\n🎟️ <b>Друга</b> — 16:00 · 5 грн\n🎫 http://u"
    assert "Поки що" in entries.tomorrow_text(events, "2026-01-01 00:00:00").first().text


def test_collection(spark):
    columns = "ord long, source string, external_id string, title string, category string, start_at timestamp_ntz, venue string, price_text string, ticket_url string, source_url string"
    batch = spark.createDataFrame([(1, "a", "1", "Шоу 20 серпня 2026, 19:00", None, None, None, "5", None, "http://x"), (2, "a", "1", "Шоу 20 серпня 2026, 19:00", None, None, None, "6", "http://t", "http://x"), (3, "b", "2", "", None, AT, None, None, None, "http://y")], columns)
    old = batch.where("ord = 1").drop("ord").withColumn("start_at", F.lit("2026-08-20 19:00:00").cast("timestamp_ntz"))
    runs = spark.createDataFrame([("a", datetime(2026, 8, 14), "success", 2)], "source string, started_at timestamp_ntz, status string, collected_count int")
    got = entries.collected(old, batch, NOW, runs)
    assert sorted((r.source, r.change_type) for r in got["changes"].collect()) == [("a", "price_changed"), ("a", "ticket_sale_started")]
    assert {(r.source, r.status, r.repaired) for r in got["summary"].collect()} == {("a", "success", 2), ("b", "error", 0)}
    assert got["snapshot"].count() == 1 and not got["gate"].first().passed
    with pytest.raises(RuntimeError, match="failed_source, quality_error"):
        entries.require(got["gate"])
    alone = entries.collected(old, batch.where("source = 'a'").withColumn("start_at", F.lit(AT)), NOW, runs, gated=False)
    entries.require(alone["gate"])
    assert alone["snapshot"].count() == 1


def test_repeated_keys_count_once(spark):
    schema = "external_id string, title string"
    old, new = spark.createDataFrame([("1", "A"), ("1", "B")], schema), spark.createDataFrame([("1", "C"), ("1", "D"), (None, "x")], schema)
    assert [(r.external_id, r.change_type) for r in changes.changes(old, new, ["external_id"], ("title",)).orderBy("external_id").collect()] == [(None, "event_created"), ("1", "field_changed")]
    assert sorted((r.external_id or "", r.title) for r in changes.upserted(old, new, ["external_id"]).collect()) == [("", "x"), ("1", "D")]


def test_islands_without_keys(spark):
    import random

    rng = random.Random(4)
    times = sorted(AT + timedelta(seconds=rng.randint(0, 90_000)) for _ in range(80))
    want, k = {}, 0
    for n, t in enumerate(times):
        k += n > 0 and (t - times[n - 1]).total_seconds() > 900
        want[n] = k
    df = spark.createDataFrame(list(enumerate(times)), "id long, ts timestamp_ntz")
    islands = canonical.islands(df, [], "ts", 900)
    got = {r.id: r.island for r in islands.collect()}
    assert len(set(want.values())) > 5 and all((got[a] == got[b]) == (want[a] == want[b]) for a in want for b in want)


def test_overlapping_sets(spark):
    import random

    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)]
    sets = lambda n: [(k, rng.sample(words, rng.choice([0, 2, 3, 5, 9, 20]))) for k in range(n)]
    a, b = sets(30), sets(40)
    got = {(r.i, r.j): r.shared for r in dedupe.overlapping_sets(spark.createDataFrame(a, "i long, w array<string>"), "i", spark.createDataFrame(b, "j long, w array<string>"), "j", 0.35, 3).collect()}
    want = {(i, j): len(set(x) & set(y)) for i, x in a for j, y in b if min(len(x), len(y)) >= 3 and len(set(x) & set(y)) >= 0.35 * min(len(x), len(y))}
    assert got == want and len(want) > 50


def test_reminder_stream_fails_and_starts_again(spark, tmp_path):
    events = stored(spark, (1, "g", "T", datetime(2026, 8, 16, 8), {"venue": "Зал"}), (2, "h", "U", datetime(2026, 8, 16, 8)))
    subs = spark.createDataFrame([(7, "g", 1440, True, None), (8, "h", 1440, True, None), (9, "g", 1440, True, None)], SUBSCRIPTIONS)
    users = spark.createDataFrame([(7,), (8,)], "telegram_id long")
    due = lambda s, now: entries.due_texts(subs, events, users, now)
    assert {r.user_id for r in due(spark, NOW).collect()} == {7, 8}
    spark.createDataFrame([(datetime(2026, 8, 15, 9),)], "at timestamp_ntz").write.parquet(str(tmp_path / "ticks"))
    ticks = jobs.stream_of(spark, str(tmp_path / "ticks"), "at timestamp_ntz")
    with answering(fails={2}) as (url, calls):
        run = lambda: jobs.reminder_stream(ticks, due, str(tmp_path / "ledger"), str(tmp_path / "state"), messages.sender(url, "t"), {"availableNow": True})
        with pytest.raises(Exception, match="1 messages failed"):
            run().awaitTermination(120)
        assert sorted(calls) == [7, 8] and jobs.ledger_rows(spark, str(tmp_path / "ledger")).count() == 1
        run().awaitTermination(120)
        assert sorted(calls) == sorted([7, 8, calls[1]]) and jobs.ledger_rows(spark, str(tmp_path / "ledger")).count() == 2
        spark.createDataFrame([(datetime(2026, 8, 15, 9, 1),)], "at timestamp_ntz").write.mode("append").parquet(str(tmp_path / "ticks"))
        run().awaitTermination(120)
        assert len(calls) == 3
    marked = jobs.marked(subs, jobs.ledger_rows(spark, str(tmp_path / "ledger")))
    assert jobs.due(marked, events, NOW).select("user_id").collect()[0].user_id == 9


def test_key_log_and_alerts(spark):
    rows = spark.createDataFrame([(1, "c", "b"), (2, "c", "a"), (3, "d", "z")], "id long, cluster string, group_key string")
    (r,) = changes.key_log(changes.propagated_keys(rows), ["id"]).collect()
    assert tuple(r) == (1, "canonical_group_assigned", "group_key", "b", "a")
    log = spark.createDataFrame([(1, "ticket_sale_started", datetime(2026, 8, 2)), (1, "ticket_sale_started", datetime(2026, 8, 1, 12)), (1, "ticket_sale_started", datetime(2026, 7, 1)), (2, "price_changed", datetime(2026, 8, 2))], "event_id long, change_type string, detected_at timestamp_ntz")
    events = spark.createDataFrame([(1, "T", None, "5", "u", 3), (2, "U", None, None, None, None)], "id long, title string, start_at timestamp_ntz, price_text string, ticket_url string, venue_id long")
    got = state.ticket_alerts(log, events, spark.createDataFrame([(3, "Зал")], "id long, name string"), "2026-08-01").collect()
    assert [(r.event_id, r.venue, r.detected_at) for r in got] == [(1, "Зал", datetime(2026, 8, 1, 12))]
