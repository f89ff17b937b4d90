"""Typed rows from pages: links, titles, JSON-LD events, line catalogues, month pages and city pages.

Pages are rows with their text already fetched. Lines are worked on with array functions, page by page, without a shuffle; a
Python worker is needed only for walking JSON of any depth and for markup.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, timeutil
from ..operators.dedupe import keep_last
from . import cards, dom

#: Lines of a line catalogue that are no titles, fixed values.
LINE_LABELS = ("театр", "концерт", "спорт", "клуб", "цирк", "дітям", "балет", "розваги", "відпочинок", "театри", "концерти")
#: Categories of a month page, fixed values.
MONTH_LABELS = ("концерти", "театри", "дітям", "stand-up", "клуби", "фестивалі", "інші")
#: Headings of a city page that are no titles, fixed values.
CITY_HEADINGS = ("Події у місті", "Вистави та концерти у Тернополі")


def _whole(hrefs: Column) -> Column:
    """Absolute links, without brackets and stops at their ends, each once."""
    return F.array_distinct(F.filter(F.transform(hrefs, lambda h: F.regexp_replace(h, r"[)\],.;]+$", "")), lambda h: h.isNotNull()))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): targets of anchors of pages (page_id, url, html) in page order, made absolute, trailing brackets and stops cut, each once per page."""
    return pages.select("page_id", F.posexplode(_whole(dom.absolute_all("url", dom.hrefs("html")))).alias("pos", "href"))


def first_match(html: Column, tag: str) -> Column:
    return F.nullif(text.squeezed(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " ")), F.lit(""))


def lines(html: Column) -> Column:
    """Cleaned non-empty lines of a page or text: tags end lines."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "\n"), r"<[^>]*>", "\n")
    return F.filter(F.transform(F.split(plain, r"\R"), text.squeezed), lambda x: x != "")


_JSONLD = "array<struct<name string, start string, venue string, address string, price string, ticket_url string, url string, description string>>"


def _first(x):
    return (x[0] if x else None) if isinstance(x, list) else x


def _event(x: dict) -> dict:
    place, offer = _first(x.get("location")), _first(x.get("offers"))
    place, offer = (y if isinstance(y, dict) else {} for y in (place, offer))
    address = place.get("address")
    address = address.get("streetAddress") if isinstance(address, dict) else address
    found = {"name": x["name"], "start": x["startDate"], "venue": place.get("name"), "address": address, "price": offer.get("price"), "ticket_url": offer.get("url"), "url": x.get("url"), "description": x.get("description")}
    return {k: None if v is None or isinstance(v, (dict, list)) else str(v) for k, v in found.items()}


def _events_of(body: str) -> list[dict]:
    """Events of one script in the order of a walk; a stack instead of recursion, so that depth is no matter."""
    try:
        stack, out = [json.loads(body)], []
    except (ValueError, RecursionError):
        return []
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack += reversed(x)
        elif isinstance(x, dict):
            kinds = x.get("@type")
            if any(isinstance(k, str) and (k == "Event" or k.rsplit("/", 1)[-1].endswith("Event")) for k in (kinds if isinstance(kinds, list) else [kinds])) and x.get("name") and x.get("startDate"):
                out.append(_event(x))
            stack += [v for k, v in reversed(x.items()) if isinstance(v, (dict, list)) and (k == "@graph" or not k.startswith("@"))]
    return out


def _jsonld(html: pd.Series) -> pd.Series:
    scripts = lambda h: re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", h or "")
    return pd.Series([[e for body in scripts(h) for e in _events_of(body)] for h in html], dtype=object)


def jsonld_events(pages: DataFrame, local: bool = False) -> DataFrame:
    """(page_id, pos, EVENT columns, description) of every Event (or subtype) with name and start in ld+json scripts of pages (page_id, url, html), at any depth.

    start_at is UTC, or with local the local fields; a start that is no time leaves it null. The id is made from the URL, the
    name and the start as it is written; of equal ids on a page the last stays. Scripts that aren't JSON are left out.
    """
    rows = pages.select("page_id", "url", F.posexplode(F.pandas_udf(_jsonld, _JSONLD)("html")).alias("pos", "e")).select("page_id", F.col("url").alias("page_url"), "pos", "e.*")
    url = dom.absolute("page_url", F.coalesce(F.nullif("url", F.lit("")), "page_url"))
    start = timeutil.iso_local(F.col("start")) if local else timeutil.iso_instant(F.col("start")).cast("timestamp_ntz")
    price = F.when(F.col("price").isNotNull(), F.concat("price", F.lit(" грн")))
    rows = rows.withColumn("source_url", url).select(
        "page_id", "pos", F.substring(F.sha2(F.concat_ws("|", "source_url", "name", "start"), 256), 1, 32).alias("external_id"), F.trim("name").alias("title"), F.lit(None).cast("string").alias("category"),
        start.alias("start_at"), "venue", "address", price.alias("price_text"), "ticket_url", "source_url", "description",
    )
    return keep_last(rows, ["page_id", "external_id"], "pos").select("page_id", "pos", *cards.EVENT, "description")


def path_links(pages: DataFrame, prefix: str, site: str | None = None) -> DataFrame:
    """(page_id, pos, href): links of pages (page_id, url, body) whose path holds prefix, from anchors, then absolute and bare ones in the text.

    Made absolute, trailing brackets and stops cut, each once per page in that order. Without site, absolute links of the text
    may be of any host.
    """
    path = re.escape(prefix) + r"[A-Za-z0-9_./%?=&-]+"
    root = f"https?://{re.escape(site) if site else '[A-Za-z0-9.-]+'}"
    anchors = F.filter(dom.hrefs("body"), lambda h: F.contains(h, F.lit(prefix)))
    found = F.concat(anchors, F.regexp_extract_all("body", F.lit(f"{root}{path}"), 0), F.regexp_extract_all("body", F.lit(f"(?:{root})?{path}"), 0))
    whole = F.filter(_whole(dom.absolute_all("url", found)), lambda h: F.contains(h, F.lit(prefix)))
    return pages.where("body is not null").select("page_id", F.posexplode(whole).alias("pos", "href"))


def _window(lines: Column, at: Column, back: int, ahead: int) -> tuple[Column, Column]:
    """The `back` lines before place `at` (from 0) and the `ahead` lines after it."""
    low = F.greatest(at - back, F.lit(0))
    return F.slice(lines, low + 1, at - low), F.slice(lines, at + 2, F.lit(ahead))


def _city_at(lines: Column, city: str, ends: str = r",|\s|$") -> Column:
    """Place (from 1) of the first line that begins with the city; 0 if none does."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(rf"(?iu)^{city}(?:{ends})")), True), F.lit(0)).cast("int")


def line_events(pages: DataFrame, now: str, city: str = text.CITY, back: int = 6, ahead: int = 19, lines_of=None) -> DataFrame:
    """Events of pages (page_id, url, body, perhaps year) whose lines have a date, then a city line within `ahead`.

    The title stands up to `back` lines before, else before the city; the venue after the city. Ended, cancelled and past
    events are left out; of equal ids the last stays. lines_of: the lines of a body, else those between its tags.
    """
    at = F.lit(now).cast("timestamp_ntz")
    year = F.col("year") if "year" in pages.columns else timeutil.year_in_text(F.col("body"), at)
    rows = pages.select("page_id", "url", year.alias("year"), (lines_of or lines)(F.col("body")).alias("lines"))
    usable = lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*LINE_LABELS)

    def dated(line, k):
        before, after = _window(F.col("lines"), k, back, ahead)
        return F.struct(k.alias("pos"), timeutil.date_of_line(line, F.col("year")).cast("timestamp_ntz").alias("start_at"), before.alias("before"), after.alias("window"))

    spots = F.filter(F.transform("lines", lambda x, k: F.when(x.rlike(timeutil.DATE_LINE), dated(x, k))), lambda d: d["start_at"] >= at)
    rows = rows.select("page_id", "url", F.explode(spots).alias("d")).select("page_id", "url", "d.*").withColumn("city_at", _city_at(F.col("window"), city)).where("city_at > 0")
    between = F.filter(F.slice("window", F.lit(1), F.col("city_at") - 1), usable)
    rows = rows.withColumn("title", F.coalesce(F.try_element_at(F.filter("before", usable), F.lit(-1)), F.get(between, F.lit(0))))
    block, after = F.array_join("window", " "), F.slice("window", F.col("city_at") + 1, F.lit(ahead))
    venue = F.when(F.get(after, F.lit(0)) == "•", F.get(after, F.lit(1))).otherwise(F.get(after, F.lit(0)))
    rows = rows.where(F.col("title").isNotNull() & ~block.rlike(text.any_pattern(text.LINE_ENDED)))
    rows = rows.select("page_id", "pos", "title", text.category_of(block).alias("category"), "start_at", venue.alias("venue"), F.lit(None).cast("string").alias("address"), text.price_of(block).alias("price_text"), F.col("url").alias("ticket_url"), F.col("url").alias("source_url"))
    return _named(rows)


def _named(rows: DataFrame) -> DataFrame:
    """rows with external_id; of equal ids on a page the last stays."""
    rows = rows.withColumn("external_id", text.external_id(F.col("source_url"), F.col("title"), F.col("start_at")))
    return keep_last(rows, ["page_id", "external_id"], "pos").select("page_id", "pos", *cards.EVENT)


def text_lines(body: Column) -> Column:
    """Cleaned non-empty lines of a text, without the signs of headings, lists and emphasis at their ends."""
    bare = lambda x: text.squeezed(F.regexp_replace(x, r"^[#*\- ]+|[#*\- ]+$", ""))
    return F.filter(F.transform(F.split(body, r"\R"), bare), lambda x: x != "")


def line_catalogue(pages: DataFrame, now: str, city: str = text.CITY) -> DataFrame:
    """line_events of pages (page_id, url, html, text); a page whose html gives none is read by its text version, with the html's year."""
    first = line_events(pages.select("page_id", "url", F.col("html").alias("body")), now, city)
    rest = pages.where("text is not null").join(first.select("page_id").distinct(), "page_id", "left_anti")
    year = timeutil.year_in_text(F.coalesce("html", F.lit("")), F.lit(now).cast("timestamp_ntz"))
    return first.unionByName(line_events(rest.select("page_id", "url", F.col("text").alias("body"), year.alias("year")), now, city, lines_of=text_lines))


def heading_blocks(rows: DataFrame, key: str, pos: str, is_heading: Column) -> DataFrame:
    """rows with block: the number of headings so far within a key; 0 is what stands before the first."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("block", F.sum(F.when(is_heading, 1).otherwise(0)).over(w))


def plain_markdown(line: Column) -> Column:
    """A line without the signs of images, bold, italic and code, with single spaces."""
    out = F.regexp_replace(line, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*([^*]*)\*\*", "$1"), r"(?U)(?<!\w)_([^_]*)_(?!\w)", "$1")
    return text.squeezed(F.regexp_replace(out, r"`([^`]*)`", "$1"))


def _label(line: Column) -> Column:
    """The label of a line that is a link, else the line."""
    return plain_markdown(F.regexp_replace(line, r"^\[([^\]]+)\]\([^)]+\)$", "$1"))


def month_page_events(pages: DataFrame, now: str, city: str = text.CITY) -> DataFrame:
    """Events of month pages (page_id, url, body: markdown or html): blocks from a date heading on, with title, categories, a line of city and date, venue, price or status.

    The city's line is the third of its block at least; the title is the last line before it that isn't of categories, and its
    link names the event. Cancelled, moved, sold out and past events are left out; of equal ids on a page the last stays.
    """
    at = F.lit(now).cast("timestamp_ntz")
    month = "(?:" + "|".join(timeutil.MONTHS) + ")"
    markup = F.coalesce(F.col("body").rlike("(?i)<html|<body"), F.lit(False))
    split = F.when(markup, dom.markdown_lines(F.when(markup, F.col("body")), "url")).otherwise(F.split("body", r"\R"))
    clean = lambda x: plain_markdown(F.regexp_replace(x, r"^[#*\- ]+|[#*\- ]+$", ""))
    rows = pages.select("page_id", "url", F.filter(F.transform(split, clean), lambda x: x != "").alias("lines"))
    heading = rf"(?iu)^\**\d{{1,2}}\**\s+.*?{month}.*?20\d{{2}}\s*$"
    place = rf"(?iu)^\[?\*{{0,2}}{city}\*{{0,2}}(?:\]\([^)]*\))?\s*,?\s*(\d{{1,2}}\s+{month}\s+20\d{{2}},\s*\d{{1,2}}:\d{{2}})\s*$"
    heads = F.filter(F.transform("lines", lambda x, k: F.when(x.rlike(heading), k)), lambda k: k.isNotNull())
    blocks = F.transform(heads, lambda k, n: F.struct(k.alias("pos"), F.slice("lines", k + 1, F.coalesce(F.get(heads, n + 1), F.size("lines")) - k).alias("lines")))
    rows = rows.select("page_id", "url", F.explode(blocks).alias("b")).select("page_id", "url", "b.*")
    located = lambda x: timeutil.date_month_page(F.nullif(F.regexp_extract(x, place, 1), F.lit("")), F.year(at))
    rows = rows.withColumn("k", F.array_position(F.transform("lines", lambda x: located(x).isNotNull()), True).cast("int")).where("k > 2").withColumn("start_at", located(F.get("lines", F.col("k") - 1)))
    is_kind = lambda x: F.forall(F.split(x, r"\|"), lambda part: F.lower(plain_markdown(part)).isin(*MONTH_LABELS))
    inner = F.slice("lines", F.lit(2), F.col("k") - 2)
    rows = rows.withColumn("line", F.try_element_at(F.filter(inner, lambda x: ~is_kind(x)), F.lit(-1))).withColumn("kinds", F.get(F.filter(inner, is_kind), F.lit(0)))
    rows = rows.withColumn("venue", _label(F.coalesce(F.get("lines", F.col("k")), F.lit("")))).withColumn("last", F.get("lines", F.col("k") + 1)).withColumn("title", _label(F.col("line")))
    price = F.when(F.col("last").rlike(r"(?iu)^(?:\d[\d\s]*(?:-|–)\s*\d[\d\s]*|\d[\d\s]*)\s*(?:грн|uah)$"), F.col("last"))
    rows = rows.where((F.col("start_at") >= at) & (F.col("title") != "") & ~F.coalesce(F.col("last").rlike(text.word_pattern(text.MONTH_PAGE_ENDED)), F.lit(False)))
    link = F.nullif(F.regexp_extract("line", r"^\[[^\]]+\]\(([^)]+)\)$", 1), F.lit(""))
    url = F.when(link.isNotNull(), dom.absolute("url", link)).otherwise(F.col("url"))
    return _named(rows.withColumn("source_url", url).select("page_id", "pos", "title", text.category_of(F.col("kinds"), text.MONTH_PAGE).alias("category"), "start_at", "venue", F.lit(None).cast("string").alias("address"), price.alias("price_text"), F.col("source_url").alias("ticket_url"), "source_url"))


def markdown_city_events(pages: DataFrame, now: str, city: str = text.CITY, base: str | None = None) -> DataFrame:
    """Events of city pages (page_id, url, body: markdown): a date line, the city's line within 7, a title up to 10 lines before, a price up to 4 after the city."""
    at = F.lit(now).cast("timestamp_ntz")
    bare = lambda x: F.regexp_replace(x, "^[#>* -]+", "")
    body = F.filter(F.transform(F.split("body", r"\R"), lambda x: bare(text.squeezed(x))), lambda x: x != "")
    rows = pages.select("page_id", "url", body.alias("lines"))

    def dated(line, k):
        before, after = _window(F.col("lines"), k, 10, 11)
        return F.struct(k.alias("pos"), timeutil.date_markdown(line).alias("start_at"), before.alias("before"), after.alias("after"))

    spots = F.filter(F.transform("lines", lambda x, k: F.when(x.rlike(timeutil.MARKDOWN_DATE), dated(x, k))), lambda d: d["start_at"] >= at)
    rows = rows.select("page_id", "url", F.explode(spots).alias("d")).select("page_id", "url", "d.*").withColumn("city_at", _city_at(F.slice("after", F.lit(1), F.lit(7)), city, ",|$")).where("city_at > 0")
    plain = lambda x: ~x.startswith("Image:") & ~x.isin(*CITY_HEADINGS) & ~x.rlike(r"(?iu)^(Детальніше|Купити квиток|від\s+\d+\s*грн)")
    line = F.get("after", F.col("city_at") - 1)
    venue = F.when(F.contains(line, F.lit(",")), F.trim(F.regexp_extract(line, r",(?s)(.*)", 1)))
    priced = F.filter(F.slice("after", F.col("city_at") + 1, F.lit(4)), lambda x: x.rlike(r"(?iu)\d\s*грн"))
    number = F.regexp_replace(F.regexp_extract(F.get(priced, F.lit(0)), r"(?iu)(?:від\s*)?(\d[\d\s]*)\s*грн", 1), r"\s", "").try_cast("long")
    url = F.lit(base) if base else F.col("url")
    rows = rows.withColumn("title", F.try_element_at(F.filter("before", plain), F.lit(-1))).where("title is not null")
    return _named(rows.select("page_id", "pos", "title", F.lit("theatre").alias("category"), "start_at", venue.alias("venue"), F.lit(city.capitalize()).alias("address"), F.when(number.isNotNull(), F.concat(F.lit("від "), number.cast("string"), F.lit(" грн"))).alias("price_text"), url.alias("ticket_url"), url.alias("source_url")))


def in_city(rows: DataFrame, now: str, stem: str = text.CITY[:6]) -> DataFrame:
    """rows that aren't past and whose venue and address, if there are any, name the city's stem."""
    where = F.lower(F.concat_ws(" ", F.nullif("venue", F.lit("")), F.nullif("address", F.lit(""))))
    return rows.where((F.col("start_at") >= F.lit(now).cast("timestamp_ntz")) & ((where == "") | F.contains(where, F.lit(stem))))


def future_city_events(pages: DataFrame, now: str, city: str = text.CITY, base: str | None = None) -> DataFrame:
    """(page_id, pos, EVENT columns) of pages (page_id, url, body) by three parsers: markdown, times, lines. Past events and other cities go; of equal ids the last parser's stays."""
    html = pages.withColumnRenamed("body", "html")
    parsers = (markdown_city_events(pages, now, city, base), cards.time_cards(html, now, city, base), line_events(pages if not base else pages.withColumn("url", F.lit(base)), now, city))
    rows = None
    for k, found in enumerate(parsers):
        found = found.withColumn("pos", F.col("pos") + k * (1 << 30))
        rows = found if rows is None else rows.unionByName(found)
    return keep_last(in_city(rows, now), ["page_id", "external_id"], "pos").select("page_id", "pos", *cards.EVENT)
