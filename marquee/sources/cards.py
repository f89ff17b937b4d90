"""Event cards in pages: a link or a time, the ancestor that is its card, and what the card says.

Each function takes pages (page_id, url, html) and returns (page_id, pos, EVENT columns). Choosing the ancestor is a filter
over the few ancestors that the page's arrays list for a link, so no row is multiplied and nothing is shuffled but to keep one
row of each id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, timeutil
from ..operators.dedupe import keep_first, keep_last
from . import dom

EVENT = ("external_id", "title", "category", "start_at", "venue", "address", "price_text", "ticket_url", "source_url")
HEADINGS = ("h1", "h2", "h3", "h4", "h5")
#: Words on links that are no titles, by dialect; fixed values.
GENERIC_LINKS = ("квитки", "купити", "детальніше", "читати далі", "купити квиток")
CATALOGUE_LINKS = ("купити", "купить", "buy", "квитки", "квиток", "детальніше", "подробнее", "more")
#: Class names of a card, fixed values.
CARD_CLASSES = ("event", "card", "item", "ticket", "afisha", "poster", "listing", "catalog")
#: Kinds of events that the generic dialect cuts off the front of a title, fixed values.
KINDS = ("Концерт", "Театр", "Стендап", "Дітям")
#: The city as catalogue cards spell it, fixed values.
CITY_NAMES = ("Тернопіль", "Тернополь")
#: Words after which a catalogue card's venue ends, and actions that are no part of it, fixed values.
STATUS_WORDS = ("Продано", "Скасовано", "Перенесено", "EVENT ENDED", "Sold out", "Cancelled", "Postponed")
ACTIONS = ("КУПИТИ", "КУПИТЬ", "BUY", "Детальніше", "Подробнее")
#: Bounds of a generic card's text.
LEAST, MOST = 50, 1800


def _any(*words: str) -> str:
    return "|".join(words)


def _word(words: tuple[str, ...]) -> str:
    """One of the words, standing alone."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])({_any(*words)})(?![\p{{L}}\p{{N}}_])"


def _trimmed(c: Column, chars: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")), F.lit(""))


def _links(pages: DataFrame, kind: str = "href", tag: str = "a") -> DataFrame:
    """(page_id, url, nodes, strings, links): links are the elements of tag that have the attribute, in page order."""
    rows = pages.select("page_id", "url", dom.parsed("html").alias("page")).select("page_id", "url", "page.nodes", "page.strings")
    return rows.withColumn("links", F.filter("nodes", lambda n: (n["tag"] == tag) & n[kind].isNotNull()))


def _events(rows: DataFrame, hash_start: Column | None = None) -> DataFrame:
    rows = rows.withColumn("external_id", text.external_id(F.col("source_url"), F.col("title"), F.col("start_at")))
    return keep_last(rows.select("page_id", "pos", *EVENT), ["page_id", "external_id"], "pos").select("page_id", "pos", *EVENT)


def generic_cards(pages: DataFrame, now: str, city: str = text.CITY) -> DataFrame:
    """Cards around links: the nearest of a link and five ancestors whose text names the city, has a date and LEAST to MOST characters.

    The title is the longest (then greatest) heading, titled or named element or link text; the venue what follows the city up
    to a price. The first link to a URL wins, of equal ids the last. Pages without such a card give nothing.
    """
    at = F.lit(now).cast("timestamp_ntz")
    strings, nodes = F.col("strings"), F.col("nodes")
    text_of = lambda n: dom.text_of(strings, n)
    fits = lambda b: F.contains(F.lower(text_of(b)), F.lit(city)) & text_of(b).rlike(timeutil.GENERIC_DATE) & F.length(text_of(b)).between(LEAST, MOST)
    block = lambda a: F.get(F.filter(F.concat(F.array(a), F.transform(F.slice(a["path"], 1, 5), lambda k: F.get(nodes, k))), fits), F.lit(0))
    titled = lambda b: F.filter(dom.within(nodes, b), lambda n: n["tag"].isin(*HEADINGS) | n["cls"].rlike("title|name"))
    card = lambda a, k: F.transform(F.array(block(a)), lambda b: F.struct(k.alias("pos"), a["href"].alias("href"), text_of(b).alias("block"), F.concat(F.transform(titled(b), text_of), F.array(text_of(a))).alias("titles")))[0]
    rows = _links(pages).select("page_id", "url", F.explode(F.filter(F.transform("links", card), lambda c: c["block"] != "")).alias("c")).select("page_id", "url", "c.*")
    rows = rows.withColumn("source_url", dom.absolute("url", "href")).where(F.col("source_url").rlike("^https?://") & (F.col("source_url") != F.col("url")))
    fine = F.filter("titles", lambda x: (x != "") & ~F.lower(x).isin(*GENERIC_LINKS))
    longest = F.array_max(F.transform(fine, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    rows = rows.withColumn("title", _trimmed(F.regexp_replace(longest, rf"^(?iu)({_any(*KINDS)})\s+", ""), " —–|•"))
    rows = rows.withColumn("start_at", timeutil.date_generic(F.col("block"), at)).where(F.col("start_at").isNotNull() & F.col("title").isNotNull() & ~F.lower("title").isin(*GENERIC_LINKS))
    rows = rows.withColumn("venue", generic_venue(F.col("block"), city))
    price = F.nullif(F.trim(F.regexp_extract("block", r"(?iu)(?:від\s*)?\d[\d\s]*\s*(?:₴|грн)", 0)), F.lit(""))
    rows = rows.select("page_id", "pos", "title", text.category_of(F.col("block"), text.GENERIC).alias("category"), "start_at", "venue", F.lit(None).cast("string").alias("address"), price.alias("price_text"), F.col("source_url").alias("ticket_url"), "source_url")
    return _events(keep_first(rows, ["page_id", "source_url"], [F.col("pos")]))


def generic_venue(block: Column, city: str = text.CITY) -> Column:
    """What a card says after the city, up to a price or the word for tickets."""
    at = F.locate(city, F.lower(block), 1)
    tail = _trimmed(F.substring(block, at + len(city), F.length(block)), " ,|•—–")
    return F.when(at > 0, F.nullif(F.trim(F.get(F.split(tail, r"(?iu)\s+від\s+\d|\s+квитки(?![\p{L}\p{N}_])", 2), F.lit(0))), F.lit("")))


def _before(c: Column, part: Column) -> Column:
    """c up to part, in any case of letters; all of it if part isn't there."""
    at = F.instr(F.lower(c), F.lower(part))
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def catalogue_venue(block: Column, start: Column, price: Column) -> Column:
    """After `city •`, or after the time; up to the price or a status word, without actions."""
    dotted = F.nullif(F.regexp_extract(block, r"(?iu)Терноп(?:і|о)ль\s*[•·]\s*(.+)", 1), F.lit(""))
    marker = F.concat(F.hour(start).cast("string"), F.lit(":"), F.date_format(start, "mm"))
    spot = F.coalesce(F.instr(block, marker), F.lit(0))
    timed = F.when(spot > 0, F.substring(block, spot + F.length(marker), F.length(block))).otherwise(block)
    cut = lambda c: F.get(F.split(F.when(price.isNotNull(), _before(c, price)).otherwise(c), _word(STATUS_WORDS), 2), F.lit(0))
    return F.when(dotted.isNotNull(), _trimmed(text.squeezed(cut(dotted)), "•|,–\\-")).otherwise(_trimmed(text.squeezed(F.regexp_replace(cut(timed), _word(ACTIONS), "")), "•|,–\\-"))


def catalogue_cards(pages: DataFrame, now: str, future_only: bool = True) -> DataFrame:
    """Cards of catalogues: of a link's eight ancestors the nearest article, list item or element of a card's class, else the parent.

    Each card counts once, for its first link. Cards that don't name the city, are cancelled or moved, have no date or (with
    future_only) a past one are left out. The title is the first heading or titled element, else the longest link; the URL
    is the first link that isn't an action.
    """
    at = F.lit(now).cast("timestamp_ntz")
    strings, nodes = F.col("strings"), F.col("nodes")
    text_of = lambda n: dom.text_of(strings, n)
    is_card = lambda n: n["tag"].isin("article", "li") | n["cls"].rlike(f"(?i){_any(*CARD_CLASSES)}")
    block = lambda a: F.transform(F.array(F.transform(F.slice(a["path"], 1, 8), lambda k: F.get(nodes, k))), lambda up: F.coalesce(F.get(F.filter(up, is_card), F.lit(0)), F.get(up, F.lit(0)), a))[0]
    label = lambda n: F.struct(n["href"].alias("href"), text_of(n).alias("text"))
    heads = lambda b: F.transform(F.filter(dom.within(nodes, b), lambda n: n["tag"].isin(*HEADINGS) | n["cls"].rlike(r"(^|\s)(title|name)(\s|$)")), text_of)
    anchors = lambda b: F.transform(F.filter(dom.within(nodes, b), lambda n: (n["tag"] == "a") & n["href"].isNotNull()), label)
    card = lambda a, k: F.transform(F.array(block(a)), lambda b: F.struct(k.alias("pos"), b["i"].alias("card"), label(a).alias("own"), text_of(b).alias("block"), heads(b).alias("heads"), anchors(b).alias("anchors")))[0]
    year = timeutil.year_in_text(F.array_join("strings", " "), at)
    rows = _links(pages).select("page_id", "url", year.alias("year"), F.explode(F.transform("links", card)).alias("c")).select("page_id", "url", "year", "c.*")
    rows = keep_first(rows, ["page_id", "card"], [F.col("pos")])
    named = F.col("block").rlike(_any(*CITY_NAMES)) & ~F.col("block").rlike(text.word_pattern(text.CATALOGUE_ENDED))
    rows = rows.where(named).withColumn("start_at", timeutil.date_catalogue(F.col("block"), F.col("year"))).where("start_at is not null")
    if future_only:
        rows = rows.where(F.col("start_at") >= at)
    plain = lambda x: (x != "") & ~F.lower(x).isin(*CATALOGUE_LINKS)
    head = F.get(F.filter("heads", lambda x: plain(x) & (F.length(x) > 2)), F.lit(0))
    labels = F.transform(F.filter("anchors", lambda x: plain(x["text"]) & (F.length(x["text"]) > 2)), lambda x: x["text"])
    longest = F.get(F.filter(labels, lambda x: F.length(x) == F.array_max(F.transform(labels, F.length))), F.lit(0))
    rows = rows.withColumn("title", F.coalesce(head, longest, F.when(plain(F.col("own.text")), F.col("own.text")))).where("title is not null")
    first = F.get(F.filter("anchors", lambda x: (x["href"] != "") & plain(x["text"])), F.lit(0))["href"]
    rows = rows.withColumn("source_url", dom.absolute("url", F.coalesce(first, F.col("own.href"))))
    price = text.catalogue_price(F.col("block"))
    rows = rows.withColumn("venue", catalogue_venue(F.col("block"), F.col("start_at"), price))
    return _events(rows.select("page_id", "pos", "title", text.category_of(F.col("block"), text.CARDS).alias("category"), "start_at", "venue", F.lit(None).cast("string").alias("address"), price.alias("price_text"), F.col("source_url").alias("ticket_url"), "source_url"))


def time_cards(pages: DataFrame, now: str, city: str = text.CITY, base: str | None = None) -> DataFrame:
    """Cards around `<time datetime>`: the nearest of ten ancestors with a line of the city and a title before it.

    Local fields of the time count, its offset is dropped. base: the URL that names the events, else the page's.
    """
    at = F.lit(now).cast("timestamp_ntz")
    strings, nodes = F.col("strings"), F.col("nodes")
    lines_of = lambda n: F.slice(strings, n["first"] + 1, n["last"] - n["first"])
    place = lambda lines: F.array_position(F.transform(lines, lambda x: x.rlike(rf"(?iu)^{city}(?:,|\s|$)")), True).cast("int")
    title = lambda lines, k: F.try_element_at(F.filter(F.slice(lines, F.lit(1), k - 1), lambda x: (F.length(x) > 2) & ~x.rlike(r"(?iu)^(Детальніше|Купити квиток|Image:)")), F.lit(-1))
    found = lambda lines: F.when(place(lines) > 0, F.struct(title(lines, place(lines)).alias("title"), F.get(lines, place(lines) - 1).alias("line")))
    card = lambda a, k: F.struct(k.alias("pos"), a["at"].alias("raw"), F.get(F.filter(F.transform(a["path"], lambda p: found(lines_of(F.get(nodes, p)))), lambda c: c["title"].isNotNull()), F.lit(0)).alias("c"))
    rows = _links(pages, "at", "time").select("page_id", "url", F.explode(F.transform("links", card)).alias("t")).select("page_id", "url", "t.pos", "t.raw", "t.c.*")
    rows = rows.withColumn("start_at", timeutil.iso_local(F.col("raw"))).where((F.col("start_at") >= at) & F.col("title").isNotNull())
    url = F.lit(base) if base else F.col("url")
    venue = F.when(F.contains("line", F.lit(",")), F.trim(F.regexp_extract("line", r",(?s)(.*)", 1)))
    return _events(rows.select("page_id", "pos", "title", F.lit("theatre").alias("category"), "start_at", venue.alias("venue"), F.lit(city.capitalize()).alias("address"), F.lit(None).cast("string").alias("price_text"), url.alias("ticket_url"), url.alias("source_url")))
