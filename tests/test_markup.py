"""Elements, links and dates of broken or odd markup, on literal inputs."""

import time
from datetime import datetime

import pytest

from marquee.sources import cards, dom, pages

NOW = "2026-08-15 00:00:00"


def page(spark, body, name="html", url="https://x.example/a/b/"):
    return spark.createDataFrame([(1, url, body)], f"page_id long, url string, {name} string")


def tree(html):
    found = dom._tree(html)
    return [(n["tag"], " ".join(found["strings"][n["first"] : n["last"]])) for n in found["nodes"]]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<p>b<div>c</div>d", [("p", "a"), ("p", "b"), ("div", "c")]),
        ("<dl><dt>a<dd>b<dt>c<dd>d</dl>e", [("dl", "a b c d"), ("dt", "a"), ("dd", "b"), ("dt", "c"), ("dd", "d")]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", [("table", "a b c"), ("tr", "a b"), ("td", "a"), ("td", "b"), ("tr", "c"), ("th", "c")]),
        ("<select><option>a<option>b</select>", [("select", "a b"), ("option", "a"), ("option", "b")]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", [("ul", "a b c d"), ("li", "a b c"), ("ul", "b c"), ("li", "b"), ("li", "c"), ("li", "d")]),
        ("<li>a<b>b<li>c", [("li", "a b"), ("b", "b"), ("li", "c")]),
        ("<div><table><tr><td>a</div>b</td></tr></table>c</div>d", [("div", "a b c"), ("table", "a b"), ("tr", "a b"), ("td", "a b")]),
        ("<p>a<table><tr><td>b</p>c</table>d", [("p", "a"), ("table", "b c"), ("tr", "b c"), ("td", "b c")]),
        ("</b></p></td>a<b>b</i>c</b>d", [("b", "b c")]),
        ("<b>a<i>b</b>c</i>d", [("b", "a b"), ("i", "b")]),
        ("<p>a<br>b<img>c</p>", [("p", "a b c"), ("br", ""), ("img", "")]),
    ],
)
def test_broken_markup(html, want):
    assert tree(html) == want


@pytest.mark.parametrize("html", ["<p>" * 100_000, "<div>" * 100_000, "<li>" * 100_000 + "</ul>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<b><i>" * 30_000 + "</b>" * 30_000, "<td><p>" * 50_000, "<ul><li>" * 40_000 + "</ul>" * 40_000])
def test_time_grows_with_the_page_only(html):
    began = time.process_time()
    dom._tree(html)
    assert time.process_time() - began < 2


def test_end_tags_reach_any_distance(spark):
    open_ones = "<b>" * 70
    one = f'<div class="event-card">{open_ones}<h3>Перша подія</h3><a href="/one">Квитки</a> 19 серпня 2026, 19:00 Тернопіль • Зал</div>'
    two = '<div class="event-card"><h3>Друга подія</h3><a href="/two">Квитки</a> 20 серпня 2026, 19:00 Тернопіль • Зал</div>'
    found = dom._tree(one + two)
    links = [n for n in found["nodes"] if n["href"]]
    assert [found["nodes"][i]["tag"] for i in links[1]["path"]] == ["div"]
    got = {r.title: r for r in cards.catalogue_cards(page(spark, f"<body>{one}{two}</body>"), NOW).collect()}
    assert got["Друга подія"].start_at == datetime(2026, 8, 20, 19)


def test_all_anchors_of_a_page(spark):
    html = """<a href='/single'>1</a><a class=x href=/bare>2</a><a data-href="/t" href="/real">3</a><A HREF="../up?a=1&amp;b=2">4</A><a>none</a><a href>empty</a>
    <!-- <a href="/comment">c</a> --><script>var x = '<a href="/script">s</a>';</script><a href="/real).">again</a><a href="https://o.example/x">5</a><a href="http://[bad">6</a>"""
    got = [r.href for r in pages.links(page(spark, html)).orderBy("pos").collect()]
    assert got == ["https://x.example/single", "https://x.example/bare", "https://x.example/real", "https://x.example/a/up?a=1&b=2", "https://o.example/x"]
    assert pages.links(spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<a href=")], "page_id long, url string, html string")).count() == 0


def test_path_links_of_any_host(spark):
    body = "<a href='/en/1'>x</a> <a title='/en/t' href=/de/2>y</a> see https://o.example/en/3). or /en/4;"
    got = [r.href for r in pages.path_links(page(spark, body, "body"), "/en/").orderBy("pos").collect()]
    assert got == ["https://x.example/en/1", "https://o.example/en/3", "https://x.example/en/t", "https://x.example/en/4"]


def test_numbers_alone_are_no_line_date(spark):
    lines = ["Гурт", "Оновлено 12.09.2030 10:00", "Тернопіль", "Зал", "Вистава", "6 вересня 2030, 20:00", "Тернопіль", "Театр"]
    (r,) = pages.line_events(page(spark, "".join(f"<p>{x}</p>" for x in lines), "body"), NOW).collect()
    assert (r.title, r.start_at, r.venue) == ("Вистава", datetime(2030, 9, 6, 20), "Театр")
