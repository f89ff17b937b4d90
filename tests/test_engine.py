"""Functions and operators of the event engine on small tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.functions import text, timeutil
from marquee.operators import canonical, changes, dedupe, health, quality
from marquee.plans import queries
from marquee.sources import pages
from marquee.streaming import jobs

NOW = "2026-07-01 00:00:00"


def test_titles_and_dates(spark):
    rows = [("Гурт | Концерт 5 серпня 2026, 19:00", 1), ("Вистава 31 лютого 2027", 2), ("Шоу 3 січня", 3), ("Solo", 4), ("Гурт, Тернопіль, Палац", 5), ("Гала від 250 грн", 6)]
    df = spark.createDataFrame(rows, "title string, k int").select("k", text.bare_title(F.col("title")).alias("t"), timeutil.date_in_text(F.col("title"), F.lit(NOW).cast("timestamp")).cast("timestamp_ntz").alias("at"))
    got = {r.k: (r.t, r.at) for r in df.collect()}
    assert got[1] == ("Гурт | Концерт", datetime(2026, 8, 5, 19)) and got[2][1] is None
    assert got[3] == ("Шоу", datetime(2027, 1, 3)) and got[4] == ("Solo", None)
    assert got[5][0] == "Гурт" and got[6][0] == "Гала"


def test_normalized_text(spark):
    df = spark.createDataFrame([("ＡＢ—c!  «Ґанок»\xa0x_1",)], "t string")
    assert df.select(text.normalized(F.col("t"), compose=True)).first()[0] == "ab c ґанок x_1"


def test_weekends_and_local_days(spark):
    days = spark.createDataFrame([("2026-08-14",), ("2026-08-15",), ("2026-08-16",)], "d string")
    assert [str(r[0]) for r in days.select(timeutil.weekend_start(F.to_date("d"))).collect()] == ["2026-08-15", "2026-08-15", "2026-08-22"]
    assert str(spark.range(1).select(timeutil.to_utc(F.lit("2026-08-19 21:00:00"))).first()[0]) == "2026-08-19 18:00:00"


def _loop(rows, same, any_member):
    clusters = []
    for r in rows:
        for c in clusters:
            if any(same(x, r) for x in (c if any_member else c[:1])):
                c.append(r)
                break
        else:
            clusters.append([r])
    return {x["ord"]: str(c[0]["ord"]) for c in clusters for x in c}


@pytest.mark.parametrize("rule", ["leader", "any"])
def test_fuzzy_clusters_against_a_loop(spark, rule):
    rng = random.Random(rule)
    base = datetime(2026, 8, 1, 18)
    titles = ["гурт океан ельзи тур", "гурт океан ельзи", "океан ельзи великий тур гурт", "вечір стендапу", "вечір стендап у", "балет лускунчик прем'єра"]
    venues = [None, "Палац культури", "палац культури березіль", "Філармонія"]
    rows = [{"ord": k, "title": rng.choice(titles), "venue": rng.choice(venues), "start_at": None if rng.random() < 0.1 else base + timedelta(minutes=rng.randint(0, 400)), "group_key": rng.choice("xyz")} for k in range(120)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "ord long, title string, venue string, start_at timestamp, group_key string")
    got = {r.ord: r.cluster.removeprefix("undated:") for r in canonical.fuzzy_clusters(df, "ord", rule).collect()}
    keys = {r.ord: (r.t, r.v) for r in df.select("ord", text.normalized(text.bare_title(F.col("title")), True).alias("t"), text.normalized(F.coalesce("venue", F.lit("")), True).alias("v")).collect()}
    same = canonical.same_occurrence(keyed=rule == "any")
    plain = [r | {"title_key": keys[r["ord"]][0], "venue_key": keys[r["ord"]][1]} for r in rows]
    assert got == _loop(plain, same, rule == "any")


def _titles(seed: int) -> list[str]:
    """Titles with variants: letters changed, words moved, dropped or put in front, cases, commas."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("абвгdeijklmnorstu", k=rng.randint(2, 9))) for _ in range(120)]
    out = []
    for _ in range(45):
        w = rng.sample(words, rng.choice([1, 2, 3, 4, 7, 12, 20, 45]))
        out += [" ".join(w), " ".join(w).upper()]
        letters = list(" ".join(w))
        for k in rng.sample(range(len(letters)), max(1, len(letters) // rng.choice([8, 12, 20, 40]))):
            letters[k] = rng.choice("xyzq ")
        out += ["".join(letters), "- " + ", ".join(w), rng.choice(words) + " " + " ".join(w), " ".join(rng.sample(w, len(w))), " ".join(w[: max(1, len(w) * 9 // 10)])]
    return rng.sample(out, len(out))


@pytest.mark.parametrize(("head", "tile"), [(3, 16), (64, 2048)])
def test_fuzzy_titles_against_by_leader(spark, tmp_path, monkeypatch, head, tile):
    monkeypatch.setattr(canonical, "HEAD", head, raising=False)
    monkeypatch.setattr(canonical, "TILE", tile, raising=False)
    docs = spark.createDataFrame([(k, f"{t}\nrest", "en" if k % 2 else "de", f"s{k % 3}") for k, t in enumerate(_titles(head))], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = text.normalized(text.bare_title(F.substring_index("text", "\n", 1)), True)
    rows = [{"ord": r.doc_id, "t": r.t} for r in docs.select("doc_id", key.alias("t")).orderBy("doc_id").collect()]
    found, first = canonical.by_leader(rows, lambda a, b: text.same_title(a["t"], b["t"])), {}
    want = {r["ord"]: str(first.setdefault(k, r["ord"])) for r, k in zip(rows, found, strict=True)}
    assert {r.doc_id: r.cluster for r in queries.canonical_fuzzy_titles(spark, str(tmp_path)).collect()} == want
    assert len(set(want.values())) < len({r["t"] for r in rows}) - 20


def test_fuzzy_duplicates_against_all_pairs(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"{t}\nrest", f"s{k % 3}") for k, t in enumerate(_titles(5)[:160])], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    title = F.substring_index("text", "\n", 1)
    rows = docs.groupBy("source", title.alias("title")).agg(F.min("doc_id").alias("ord")).select("source", "ord", text.normalized(F.col("title"), True).alias("t")).orderBy("ord").collect()
    want = {(str(a.ord), str(b.ord)) for k, a in enumerate(rows) for b in rows[k + 1 :] if a.source != b.source and text.ratio(a.t, b.t) >= 0.90}
    got = [(r.external_id_a, r.external_id_b) for r in queries.duplicate_candidates_fuzzy(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_no_array_of_a_whole_key(spark):
    plan = lambda f: f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan(queries.favorites_cluster_overlap)
    assert "Aggregate [user_id" in (found := plan(queries.canonical_leader)) and "island" in found.split("Aggregate [user_id")[1].split("]")[0]


def test_representatives(spark):
    at = datetime(2026, 8, 1, 18)
    df = spark.createDataFrame([("c", "b", "Long title", at, "10", None), ("c", "a", "Short", at - timedelta(minutes=5), None, "u")], "cluster string, source string, title string, start_at timestamp, price_text string, ticket_url string")
    r = canonical.representatives(df).first()
    assert r.event.title == "Long title" and r.start_at == at - timedelta(minutes=5) and [o.source for o in r.offers] == ["a", "b"] and r.n_sources == 2
    assert canonical.representatives(df, "any").first().event.title == "Short"


def test_duplicate_candidates(spark):
    at = datetime(2026, 8, 1, 18)
    rows = [("a", 0, "1", "Концерт: гурт!", at), ("b", 1, "2", "концерт гурт", at + timedelta(minutes=15)), ("b", 2, "3", "концерт гурт", at + timedelta(minutes=16)), ("a", 3, "4", "концерт гурт", at), ("c", 4, "5", "Лекція", at)]
    df = spark.createDataFrame(rows, "source string, ord long, external_id string, title string, start_at timestamp")
    got = {(r.external_id_a, r.external_id_b) for r in canonical.duplicate_candidates(df).collect()}
    assert got == {("1", "2"), ("2", "4")}


def test_keeping_rows(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 3, "c")], "k string, ord long, v string")
    assert {tuple(r) for r in dedupe.keep_first(df, ["k"], [F.col("ord")]).collect()} == {("k", 1, "a"), ("j", 3, "c")}
    assert {(r.k, r.v, r.ord) for r in dedupe.keep_last(df, ["k"], "ord").collect()} == {("k", "b", 1), ("j", "c", 3)}


@pytest.mark.parametrize(("counts", "statuses", "want"), [((47, 46, 49, 45), "ssss", "healthy"), ((0, 12, 11), "sss", "degraded"), ((8, 20, 22, 21), "ssss", "degraded"), ((0, 20, 21), "ess", "down"), ((5, 6), "ss", "warming"), ((), "", "unknown")])
def test_health(spark, counts, statuses, want):
    runs = [("x", datetime(2026, 8, 16, 12) - timedelta(hours=k), {"s": "success", "e": "error"}[s], n) for k, (n, s) in enumerate(zip(counts, statuses, strict=True))]
    df = spark.createDataFrame(runs, "source string, started_at timestamp, status string, collected_count int")
    up = spark.createDataFrame([], "source string, in_window long, next_event timestamp")
    names = spark.createDataFrame([("x",)], "source string")
    assert health.status(names, df, up).first().status == want
    assert health.overall(health.status(names, df, up)).first()[0] == {"down": "degraded", "degraded": "degraded", "unknown": "warming"}.get(want, "healthy")
    assert health.status(names, df.withColumn("collected_count", F.lit(0)), up, ("x",)).first().status != "degraded"


def test_quality_rules(spark):
    rows = [("s", "", " ", "ftp://x", None, "x:y"), ("s", "1", "T", "", datetime(2020, 1, 1), None), ("t", "2", "T", "HTTP://x", datetime(2027, 1, 1), "")]
    df = spark.createDataFrame(rows, "source string, external_id string, title string, source_url string, start_at timestamp_ntz, ticket_url string")
    found = quality.issues(df, NOW)
    assert sorted(r.code for r in found.collect()) == sorted(["missing_external_id", "missing_title", "invalid_source_url", "missing_start_at", "invalid_ticket_url", "missing_source_url", "past_event"])
    assert [r.external_id for r in quality.gate(df, found).collect()] == ["2"]


def test_upsert_and_changes(spark):
    schema = "external_id string, title string, category string, start_at timestamp, price_text string, ticket_url string, venue string"
    old = spark.createDataFrame([("1", "A", None, None, "5", "", "v"), ("2", "B", None, None, None, "u", None)], schema)
    new = spark.createDataFrame([("1", "A2", None, None, "5", "http://t", None), ("3", "C", None, None, None, None, "w")], schema)
    assert sorted((r.external_id, r.change_type) for r in changes.changes(old, new, ["external_id"]).collect()) == [("1", "field_changed"), ("1", "ticket_sale_started"), ("3", "event_created")]
    assert {r.external_id: (r.title, r.venue) for r in changes.upserted(old, new, ["external_id"]).collect()} == {"1": ("A2", "v"), "2": ("B", None), "3": ("C", "w")}


def test_jsonld(spark):
    html = """<script type="application/ld+json">{"@graph":[{"@type":"MusicEvent","name":"N","startDate":"2026-08-01T19:00:00Z","location":[{"name":"P","address":{"streetAddress":"S 1"}}],"offers":{"price":100,"url":"http://t"}},
    {"@type":"Thing"},{"@type":["Event"],"name":"M","startDate":"2026-08-02","location":"Hall"}]}</script><script type="application/ld+json">broken</script>"""
    got = [(r.title, r.start_at, r.venue, r.address, r.price_text, r.ticket_url) for r in pages.jsonld_events(spark.createDataFrame([(1, "http://p/x", html), (2, "http://p/y", None)], "page_id long, url string, html string")).orderBy("pos").collect()]
    assert got == [("N", datetime(2026, 8, 1, 19), "P", "S 1", "100 грн", "http://t"), ("M", datetime(2026, 8, 2), None, None, None, None)]


def test_line_catalogue(spark):
    body = "Афіша 2026\nБалет Лускунчик\nтеатр\n5 вересня 19:00\nТернопіль, центр\n•\nПалац\n200 - 500 грн\n" + "\n".join(f"рядок {k}" for k in range(20)) + "\nСтара подія\n1 травня 2026, 19:00\nТернопіль\nЗал\n" + "\n".join(f"ще {k}" for k in range(20)) + "\nГурт\n6 вересня 2026, 20:00\nТернопіль\nСкасовано"
    got = pages.line_events(spark.createDataFrame([(1, "http://x", body)], "page_id long, url string, body string"), NOW).collect()
    assert [(r.title, str(r.start_at), r.venue, r.category, r.price_text) for r in got] == [("Балет Лускунчик", "2026-09-05 19:00:00", "Палац", None, "200 - 500 грн")]


def test_month_page(spark):
    body = "Афіша\n5 серпня 2026\n[Гурт](http://e/1)\nконцерти | клуби\nТернопіль, 5 серпня 2026, 19:00\nПалац\n300 грн\n6 серпня 2026\nШоу\nстенд\nТернопіль, 6 серпня 2026, 18:00\nЗал\nСкасовано\n"
    got = pages.month_page_events(spark.createDataFrame([(1, "http://x", body)], "page_id long, url string, body string"), NOW).collect()
    assert [(r.title, r.source_url, r.venue, r.category, r.price_text) for r in got] == [("Гурт", "http://e/1", "Палац", "concert", "300 грн")]


def test_streams(spark, tmp_path):
    rows = [(k, datetime(2026, 8, 1, 10) + timedelta(minutes=7 * k), k % 3, "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_of(spark, str(tmp_path / "in"), df.schema)
    for name, job in (("seen", lambda x: jobs.first_last_seen(x, ["user_id"])), ("counts", jobs.tumbling_counts)):
        q = job(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {tuple(r) for r in spark.table(name).collect()} == {tuple(r) for r in job(df).collect()}


def test_reminders_are_delivered_once(spark, tmp_path):
    now = "2026-08-01 12:00:00"
    events = spark.createDataFrame([(1, "g", "T", datetime(2026, 8, 2, 11), "active"), (2, "g", "T", datetime(2026, 7, 1), "active")], "id long, group_key string, title string, start_at timestamp_ntz, status string")
    subs = spark.createDataFrame([(7, "g", 1440, True, None), (8, "g", 60, True, None), (9, "g", 1440, False, None), (10, "g", 1440, True, datetime(2026, 8, 1, 11, 30))], "user_id long, group_key string, notify_before_minutes int, enabled boolean, last_notified_at timestamp_ntz")
    found = jobs.due(subs, events, now)
    assert [(r.user_id, r.event_id) for r in found.collect()] == [(7, 1)]
    for _ in range(2):
        jobs.deliver(found, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 1
