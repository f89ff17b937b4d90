"""Readers of pages on literal inputs: month pages, city pages, catalogues, cards, JSON-LD, crawls, the registry."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marquee.functions import text, timeutil
from marquee.sources import cards, crawl, dom, pages, registry

NOW = "2026-08-15 00:00:00"
MONTH_PAGE = """19 Ср серпня ’ 2026
[«Кіно для дорослих»](https://x.example/event/kino/)
театри
Тернопіль, 19 серпня 2026, 18:00
Тернопільський театр
300 - 650 грн
КУПИТИ
"""
MONTH_MARKDOWN = """**19** Ср _серпня ’ 2026_
[![Image](https://img.example/test.jpg)](https://x.example/kino-4/)
[«Кіно для дорослих»](https://x.example/kino-4/)
театри
**Тернопіль**, 19 серпня 2026, 18:00
Тернопільський театр
**300 - 650 грн**
[КУПИТИ](https://x.example/kino-4/order/)
"""
CITY_PAGE = "### Я бачу, вас цікавить пітьма\n\n08 жовтня 2026, 18:00\n\nТернопіль, Драмтеатр\n\nвід 990 грн.\n\n### Я, Побєда і Берлін\n\n25 жовтня 2026, 18:00\n\nТернопіль, Драмтеатр\n\nвід 490 грн.\n"


def page(spark, body, name="body", url="https://x.example/august/"):
    return spark.createDataFrame([(1, url, body)], f"page_id long, url string, {name} string")


@pytest.mark.parametrize(("body", "url"), [(MONTH_PAGE, "https://x.example/event/kino/"), (MONTH_MARKDOWN, "https://x.example/kino-4/")])
def test_month_page_dialects(spark, body, url):
    (r,) = pages.month_page_events(page(spark, body), NOW).collect()
    assert (r.title, r.start_at, r.price_text, r.source_url, r.ticket_url) == ("«Кіно для дорослих»", datetime(2026, 8, 19, 18), "300 - 650 грн", url, url)
    assert (r.venue, r.category) == ("Тернопільський театр", "theatre")


def test_month_page_of_html_and_statuses(spark):
    html = """<html><body><h3>19 Ср серпня ’ 2026</h3><p><a href="../event/kino/">Балет</a></p><p>театри | клуби</p><p>Тернопіль, 19 серпня 2026, 18:00</p><p>Палац</p><p>300 грн</p>
    <h3>20 Чт серпня ’ 2026</h3><p>Сильні серця</p><p>концерти</p><p>Тернопіль, 20 серпня 2026, 18:00</p><p>Палац</p><p>Продано</p>
    <h3>2 Нд серпня ’ 2026</h3><p>Давнє</p><p>Тернопіль, 2 серпня 2026, 18:00</p><p>Палац</p><p>1 грн</p></body></html>"""
    got = pages.month_page_events(page(spark, html), NOW).collect()
    assert [(r.title, r.source_url, r.venue, r.category, r.price_text) for r in got] == [("Балет", "https://x.example/event/kino/", "Палац", "theatre", "300 грн")]


def test_city_page(spark):
    got = pages.markdown_city_events(page(spark, CITY_PAGE), "2026-08-15 08:00:00", base="https://c.example/city").orderBy("pos").collect()
    assert [(r.title, r.start_at, r.venue, r.price_text, r.source_url) for r in got] == [
        ("Я бачу, вас цікавить пітьма", datetime(2026, 10, 8, 18), "Драмтеатр", "від 990 грн", "https://c.example/city"),
        ("Я, Побєда і Берлін", datetime(2026, 10, 25, 18), "Драмтеатр", "від 490 грн", "https://c.example/city"),
    ]
    assert pages.future_city_events(page(spark, CITY_PAGE), NOW).count() == 2
    elsewhere = spark.createDataFrame([(datetime(2026, 9, 1), "Зал", "Львів"), (datetime(2026, 9, 1), None, ""), (datetime(2026, 9, 1), "Тернопільський театр", None), (datetime(2026, 8, 1), None, None)], "start_at timestamp_ntz, venue string, address string")
    assert pages.in_city(elsewhere, NOW).count() == 2


def test_line_catalogue_of_html_and_text(spark):
    filler = "".join(f"<div>службовий рядок {k}</div>" for k in range(1, 15))
    html = f"""<html><body><main><article><div>Тестова подія</div><div>20 серпня 2026, 19:00</div><div>Концерт</div><div>Тернопіль</div><div>•</div><div>Тестовий майданчик</div><div>300 грн</div></article>
    {filler}<article><div>Стара подія</div><div>18 серпня 2026, 19:00</div><div>Концерт</div><div>Тернопіль</div><div>•</div><div>Тестовий майданчик</div><div>300 грн</div><div>ПОДІЯ ЗАКІНЧИЛАСЬ</div></article></main></body></html>"""
    rows = spark.createDataFrame([(1, "https://a.example/", html, None), (2, "https://b.example/", "<p>Афіша 2027</p>", "## Гурт\n- 6 вересня 20:00\n* Тернопіль\nПродано\nЗал"), (3, "https://c.example/", "<p>x</p>", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.line_catalogue(rows, "2026-08-17 15:00:00").collect()}
    assert set(got) == {1, 2}
    assert (got[1].title, got[1].start_at, got[1].price_text, got[1].venue, got[1].category, got[1].source_url) == ("Тестова подія", datetime(2026, 8, 20, 19), "300 грн", "Тестовий майданчик", "concert", "https://a.example/")
    assert (got[2].title, got[2].start_at) == ("Гурт", datetime(2027, 9, 6, 20))


def test_generic_cards(spark):
    html = """<div><div class="box"><h3>Концерт Гурт Океан: великий тур</h3><span>19.08.2026 р. 19:00</span> Тернопіль, Палац культури від 250 грн <a href="/e/1">Квитки</a><a href="/e/2">Детальніше</a></div>
    <div><a href="e/3">Стендап про все на світі у четвер ввечері</a> 3 січня 18:30 Тернопіль квитки онлайн</div><a href="mailto:x">Пошта</a><p><a href="/far">Без дати, але з довгим текстом у Тернополі і ще з чимось</a></p></div>"""
    got = {r.source_url: r for r in cards.generic_cards(page(spark, html, "html", "https://g.example/a/"), NOW).collect()}
    assert set(got) == {"https://g.example/e/1", "https://g.example/e/2", "https://g.example/a/e/3", "https://g.example/far"}
    one, three = got["https://g.example/e/1"], got["https://g.example/a/e/3"]
    assert (one.title, one.start_at, one.venue, one.price_text, one.category) == ("Гурт Океан: великий тур", datetime(2026, 8, 19, 19), "Палац культури", "від 250 грн", "concert")
    assert (three.start_at, three.category, three.price_text) == (datetime(2027, 1, 3, 18, 30), "standup", None)


def test_catalogue_cards(spark):
    html = """<html><body>Афіша 2026<ul><li><a href="/buy/1">Купити</a><h4>Великий концерт</h4><a href="/show/1">Великий концерт гурту</a> 17 вересня 19:00 вівторок Тернопіль • Палац культури 200 - 500 грн</li>
    <li><a href="/show/2">Вистава дня</a> 18 вересня '2026 о 18:00 Тернопіль Скасовано</li></ul>
    <div class="event-row"><b><a href="../s/3">Мюзикл</a></b> Тернопіль, 5 ср жовтня 2026, 18:00 Драмтеатр від 100 ₴ КУПИТИ</div><div class="card"><a href="/s/4">Давня подія</a> Тернопіль 1 травня 2026 18:00</div></body></html>"""
    rows = page(spark, html, "html", "https://k.example/x/y/")
    got = {r.source_url: r for r in cards.catalogue_cards(rows, NOW).collect()}
    assert set(got) == {"https://k.example/show/1", "https://k.example/x/s/3"}
    one, three = got["https://k.example/show/1"], got["https://k.example/x/s/3"]
    assert (one.title, one.start_at, one.venue, one.price_text.strip(), one.category) == ("Великий концерт", datetime(2026, 9, 17, 19), "Палац культури", "200 - 500 грн", "concert")
    assert (three.title, three.start_at, three.venue) == ("Мюзикл", datetime(2026, 10, 5, 18), "Драмтеатр")
    assert cards.catalogue_cards(rows, NOW, future_only=False).count() == 3


def test_time_cards_and_empty_pages(spark):
    html = '<section><div><h2>Опера</h2><p><time datetime="2026-09-01T19:00:00+03:00">1 вересня</time></p></div><p>Тернопіль, Оперний зал</p></section><time datetime="2026-08-01T10:00">x</time><time datetime="broken">y</time>'
    (r,) = cards.time_cards(page(spark, html, "html"), NOW).collect()
    assert (r.title, r.start_at, r.venue, r.address) == ("1 вересня", datetime(2026, 9, 1, 19), "Оперний зал", "Тернопіль")
    none = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<li><li></p></ul><a href='http://[x'>")], "page_id long, url string, html string")
    for read in (cards.generic_cards, cards.catalogue_cards, cards.time_cards):
        assert read(none, NOW).count() == 0


def test_elements_of_a_page(spark):
    html = "<ul><li>a<li>b <b>c</b></ul><script>no</script><p class='x y'>d<br>e"
    found = page(spark, html, "html").select(dom.parsed("html").alias("p")).select("p.*").first()
    assert found.strings == ["a", "b", "c", "d", "e"]
    assert [(n.tag, n["first"], n["last"], n.upto) for n in found.nodes] == [("ul", 0, 3, 4), ("li", 0, 1, 2), ("li", 1, 3, 4), ("b", 2, 3, 4), ("script", 3, 3, 5), ("p", 3, 5, 7), ("br", 4, 4, 7)]
    lines = page(spark, "<p>x <a href='../y'>go <i>on</i></a> z</p>", "html", "http://h/a/b/").select(dom.markdown_lines("html", "url")).first()[0]
    assert lines == ["x", "[go on](http://h/a/y)", "z"]


def test_jsonld_ids_depth_and_times(spark):
    deep = '{"@type":"Thing","x":' * 400 + '{"@type":"https://schema.org/MusicEvent","name":" N ","startDate":"2026-08-20T19:00:00+03:00","url":"../e/1","offers":{"price":0}}' + "}" * 400
    html = f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">{"[" * 200_000}</script><script type="application/ld+json">[{{"@type":"Event","name":"A","startDate":"soon","location":[]}},{{"@type":"Event","name":"A","startDate":"soon","description":"last"}}]</script>'
    rows = page(spark, html, "html", "https://j.example/a/b/")
    got = {r.title: r for r in pages.jsonld_events(rows).collect()}
    import hashlib

    assert set(got) == {"N", "A"} and got["N"].start_at == datetime(2026, 8, 20, 16) and got["N"].price_text == "0 грн" and got["N"].source_url == "https://j.example/a/e/1"
    assert got["N"].external_id == hashlib.sha256("https://j.example/a/e/1| N |2026-08-20T19:00:00+03:00".encode()).hexdigest()[:32]
    assert got["A"].start_at is None and got["A"].description == "last"
    assert {r.start_at for r in pages.jsonld_events(rows, local=True).collect() if r.title == "N"} == {datetime(2026, 8, 20, 19)}


def test_path_links(spark):
    body = "<a href='/tours/one'>x</a> <a href=\"/other\">y</a> see https://t.example/tours/two). and /tours/one, or /tours/three."
    got = [r.href for r in pages.path_links(page(spark, body, url="https://t.example/"), "/tours/", "t.example").orderBy("pos").collect()]
    assert got == ["https://t.example/tours/one", "https://t.example/tours/two", "https://t.example/tours/three"]


def test_crawl_of_a_city(spark):
    event = lambda n, day: f'<script type="application/ld+json">{{"@type":"TheaterEvent","name":"{n}","startDate":"2026-09-{day}T18:00:00","location":{{"name":"Тернопіль, Зал"}}}}</script>'
    rows = [
        ("https://t.example/city", "<p>Афіша</p><a href='/events/a'>a</a>", "see https://t.example/events/b."),
        ("https://t.example/", "<p>nothing</p>", "https://t.example/tours/one https://t.example/tours/gone"),
        ("https://t.example/tours/one", "<p>tour</p>", "https://t.example/events/c https://t.example/events/a"),
        ("https://t.example/events/a", event("A", "01"), None),
        ("https://t.example/events/b", "<p>x</p>", "Б-подія\n2 вересня 19:00\nТернопіль\nТернопільський зал"),
        ("https://t.example/events/c", event("C", "03").replace("Тернопіль", "Львів"), None),
        ("https://t.example/events/d", event("D", "04"), None),
    ]
    table = spark.createDataFrame(rows, "url string, html string, text string")
    got = {r.title: r for r in crawl.city_events(table, "https://t.example/city", "https://t.example/", NOW).collect()}
    assert set(got) == {"A", "Б-подія"} and got["A"].start_at == datetime(2026, 9, 1, 18)
    direct = spark.createDataFrame([("https://t.example/city", "<p>Опера</p><p>5 вересня 2026, 19:00</p><p>Тернопіль</p><p>Зал</p>", None), *rows[1:]], table.schema)
    assert [r.title for r in crawl.city_events(direct, "https://t.example/city", "https://t.example/", NOW).collect()] == ["Опера"]


def test_months_wrap_and_missing_pages_are_skipped(spark):
    assert timeutil.month_urls("https://m.example/", "2026-11-03 00:00:00", 4) == ["https://m.example/november/", "https://m.example/december/", "https://m.example/january/", "https://m.example/february/"]
    table = spark.createDataFrame([("https://m.example/august/", None, MONTH_PAGE), ("https://m.example/september/", MONTH_PAGE.replace("300 - 650", "700"), None)], "url string, html string, text string")
    (r,) = crawl.month_events(table, "https://m.example", NOW).collect()
    assert r.price_text == "700 грн"


def test_registry(spark):
    read = cards.generic_cards
    good = [registry.Source("a", "https://a.example", read), registry.Source("", "x", None, production=False)]
    registry.validate(spark, good)
    bad = [registry.Source("a", "https://a.example", read), registry.Source("a", "ftp://b", read), registry.Source(" ", "https://a.example", None), registry.Source("c", None, read)]
    assert sorted((r.number, r.problem.split(" ")[0]) for r in registry.problems(spark, bad).collect()) == [(2, "base_url"), (2, "duplicate"), (3, "duplicate"), (3, "name"), (3, "read"), (4, "base_url")]
    with pytest.raises(RuntimeError, match="#2.*\n.*#3"):
        registry.validate(spark, bad)
    assert len(registry.addresses("https://t.example", NOW, 4, ("a", "b", "c", "d"))) == 9


def test_dates_in_dialects(spark):
    now = F.lit(NOW).cast("timestamp_ntz")
    cases = [("g", "19-08-2026 9:05", datetime(2026, 8, 19, 9, 5)), ("g", "1 серпня 10:00", datetime(2027, 8, 1, 10)), ("g", "15 серпня 00:00", datetime(2026, 8, 15)), ("g", "31.02.2026 10:00", None), ("c", "5 сер жовтня '2026 о 18:00", datetime(2026, 10, 5, 18)), ("c", "17 вересня 19:00", datetime(2025, 9, 17, 19)), ("m", "19 Ср серпня ’ 2026, 18:00", datetime(2026, 8, 19, 18)), ("m", "ні", None)]
    df = spark.createDataFrame([(k, s) for k, s, _ in cases], "k string, s string")
    found = F.when(F.col("k") == "g", timeutil.date_generic(F.col("s"), now)).when(F.col("k") == "c", timeutil.date_catalogue(F.col("s"), F.lit(2025))).otherwise(timeutil.date_month_page(F.col("s"), F.lit(2025)))
    assert [r[0] for r in df.select(found).collect()] == [want for *_, want in cases]


def test_card_and_reminder_texts(spark):
    df = spark.createDataFrame([("Лос Янковерс 9 вересня 2026 18:00", datetime(2026, 9, 9, 15), "Театр", ["300 грн", None, "100 грн", "300 грн"]), ("Без дати", None, None, [])], "t string, s timestamp_ntz, v string, p array<string>")
    got = [r[0] for r in df.select(text.event_card(F.col("t"), F.col("s"), F.col("v"), F.col("p"))).collect()]
    assert got[0] == "🎟️ <b>Лос Янковерс</b>\n📅 09.09.2026\n🕐 18:00\n📍 Театр\n💰 100 грн, 300 грн\n" and got[1] == "🎟️ <b>Без дати</b>\n📅 Дата уточнюється\n🕐 Час уточнюється\n📍 Тернопіль\n"
    rem = df.select(text.reminder(F.col("t"), F.col("s"), F.col("v"), F.get("p", F.lit(0)), F.when(F.col("s").isNotNull(), F.lit("http://u")))).collect()
    assert rem[0][0].split("\n")[3:] == ["📅 09.09.2026 о 15:00", "📍 Театр", "💰 300 грн", "", '🎫 <a href="http://u">Купити квиток</a>'] and rem[1][0].count("\n") == 2
