"""Crawls over tables of fetched pages: months, and a city's tours and events in three hops, each hop a join of links with pages.

pages: (url, html, text), both versions as fetched; a page that failed has no row, or a null version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, timeutil
from ..operators.dedupe import keep_last
from . import cards
from . import pages as sources

#: Tours and events that one crawl follows: the feature's limits.
TOURS, EVENTS = 50, 100


def fetched(pages: DataFrame, first: str = "text", then: str = "html") -> DataFrame:
    """(url, body): the first version of a page that was fetched."""
    return pages.select("url", F.coalesce(first, then).alias("body")).where("body is not null")


def month_events(pages: DataFrame, base: str, now: str, months: int = 6, city: str = text.CITY) -> DataFrame:
    """EVENT columns of the months' pages from now's on; missing pages are skipped, of equal ids the last page's stays."""
    urls = timeutil.month_urls(base, now, months)
    wanted = pages.sparkSession.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = sources.month_page_events(fetched(pages).join(F.broadcast(wanted), "url").select("page_id", "url", "body"), now, city)  # as many as months
    return keep_last(rows.withColumn("pos", F.struct("page_id", "pos")), ["external_id"], "pos").select(*cards.EVENT)


def _asked(links: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """pages of the first `most` different links (place, href), by place."""
    first = links.groupBy("href").agg(F.min("place").alias("place")).orderBy("place").limit(most)  # a limit of the feature
    numbered = first.withColumn("page_id", F.row_number().over(W.orderBy("place")).cast("long"))
    return pages.join(numbered, pages.url == numbered.href).select("page_id", "url", "html", "text")


def _links_of(pages: DataFrame, prefix: str, site: str, fallback: bool) -> DataFrame:
    """(page_id, version, pos, href) of both versions of pages; with fallback the text's only where the html has none."""
    of = lambda v, k: sources.path_links(pages.where(F.col(v).isNotNull()).select("page_id", "url", F.col(v).alias("body")), prefix, site).withColumn("version", F.lit(k))
    html, plain = of("html", 0), of("text", 1)
    return html.unionByName(plain.join(html.select("page_id").distinct(), "page_id", "left_anti") if fallback else plain)


def _both(pages: DataFrame, parse, fallback_only: DataFrame | None = None) -> DataFrame:
    """parse of the html versions, then of the text versions, which come after in pos; with fallback_only only for its pages."""
    plain = pages.where("text is not null")
    if fallback_only is not None:
        plain = plain.join(fallback_only, "page_id", "left_semi")
    first = parse(pages.where("html is not null").select("page_id", "url", F.col("html").alias("body")))
    return first.withColumn("version", F.lit(0)).unionByName(parse(plain.select("page_id", "url", F.col("text").alias("body"))).withColumn("version", F.lit(1)))


def city_events(pages: DataFrame, city_url: str, home_url: str, now: str, city: str = text.CITY, tours: str = "/tours/", events: str = "/events/") -> DataFrame:
    """EVENT columns of a city's page; if its lines give none, of a crawl: the city's page, the home page's tours, and the events that both link to.

    TOURS tours and EVENTS different events are followed, in the order of links. An event's page is read as JSON-LD, else by
    lines, in html, else in text. Past events and other cities are left out; of equal ids the one found last stays.
    """
    site = home_url.split("://", 1)[-1].strip("/")
    one = lambda url: pages.where(F.col("url") == url).select(F.lit(0).cast("long").alias("page_id"), "url", "html", "text")
    start = one(city_url)
    direct = sources.line_catalogue(start, now, city)
    if not direct.isEmpty():
        return direct.select(*cards.EVENT)
    parse = lambda rows: sources.future_city_events(rows, now, city, base=city_url)
    tour_pages = _asked(_links_of(one(home_url), tours, site, True).select(F.struct("version", "pos").alias("place"), "href"), pages, TOURS)
    tour_links = _links_of(tour_pages, events, site, True)
    bare = tour_pages.select("page_id").join(tour_links.where("version = 0").select("page_id").distinct(), "page_id", "left_anti")
    place = lambda k: F.struct(F.lit(k).alias("stage"), "page_id", "version", "pos").alias("place")
    links = _links_of(start, events, site, False).select(place(0), "href").unionByName(tour_links.select(place(1), "href"))
    event_pages = _asked(links, pages, EVENTS)

    def event_page(rows: DataFrame) -> DataFrame:
        found = sources.jsonld_events(rows.withColumnRenamed("body", "html"), local=True).drop("description").where(F.col("start_at") >= F.lit(now).cast("timestamp_ntz"))
        rest = rows.join(found.select("page_id").distinct(), "page_id", "left_anti")
        return found.unionByName(sources.line_events(rest.withColumn("year", F.lit(int(now[:4]))), now, city))

    by_html = event_page(event_pages.where("html is not null").select("page_id", "url", F.col("html").alias("body")))
    unread = event_pages.select("page_id").join(by_html.select("page_id").distinct(), "page_id", "left_anti")
    stages = (_both(start, parse), _both(tour_pages, parse, bare), _both(event_pages, event_page, unread))
    rows = None
    for k, found in enumerate(stages):
        found = found.withColumn("pos", F.struct(F.lit(k).alias("stage"), "page_id", "version", "pos"))
        rows = found if rows is None else rows.unionByName(found)
    return keep_last(sources.in_city(rows.select("pos", *cards.EVENT), now), ["external_id"], "pos").select(*cards.EVENT)
