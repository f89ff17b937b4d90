"""A whole collection: readers by themselves, empty and failed sources, duplicates, canonical keys, the report."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marquee.plans import entries
from marquee.sources import cards, registry
from marquee.tables import Scratch

NOW = "2026-08-15 00:00:00"
CARD = '<div class="event-card"><h3>{0}</h3><a href="/{1}">Квитки</a> {2} серпня 2026, 19:00 Тернопіль • Палац культури 200 грн</div>'


def broken(pages, now):
    raise ValueError("the page has another form\nand more")


def late(pages, now):
    """Fails when it runs, not when it is planned."""
    return cards.catalogue_cards(pages, now).withColumn("title", F.raise_error(F.lit("a broken row")).cast("string"))


@pytest.fixture(scope="module")
def run(spark):
    pages = [
        ("https://a.example/list", CARD.format("Великий концерт гурту Океан", "1", 20) + CARD.format("Вистава дня", "2", 21)),
        ("https://b.example/list", CARD.format("Великий концерт гурту «Океан»", "x", 20)),
        ("https://c.example/list", CARD.format("Лекція", "y", 22)),
        ("https://d.example/list", "<p>nothing here</p>"),
        ("https://e.example/list", "<p>nothing here either</p>"),
    ]
    df = spark.createDataFrame([(k, u, f"<body>{h}</body>") for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    read = cards.catalogue_cards
    sources = [registry.Source(x, f"https://{x}.example", f) for x, f in (("a", read), ("b", read), ("c", late), ("d", read), ("e", read), ("f", broken))] + [registry.Source("g", "https://g.example", broken, production=False)]
    scratch = Scratch(spark, "test")
    batch, failures = entries.read_sources(sources, df, NOW, scratch)
    old = batch.where("false").drop("ord")
    runs = spark.createDataFrame([("a", datetime(2026, 8, 14), "success", 2)], "source string, started_at timestamp_ntz, status string, collected_count int")
    names = spark.createDataFrame([(s.name,) for s in sources if s.production], "source string")
    found = entries.collected(old, batch, NOW, runs, names=names, failures=failures, allow_empty=("e",))
    return found | entries.canonical_run(found, scratch)


def test_one_source_does_not_stop_another(run):
    got = {r.source: (r.status, r.collected, r.changed, r.error_text) for r in run["summary"].collect()}
    assert got["e"][3] is None
    assert {k: v[:3] for k, v in got.items()} == {"a": ("success", 2, 2), "b": ("success", 1, 1), "c": ("error", 0, 0), "d": ("error", 0, 0), "e": ("success", 0, 0), "f": ("error", 0, 0)}
    assert got["d"][3] == "no rows" and got["f"][3] == "ValueError: the page has another form" and got["c"][3]
    assert sorted(r.source for r in run["snapshot"].collect()) == ["a", "a", "b"]


def test_runs_and_health(run):
    assert {r.source: (r.status, r.collected_count) for r in run["runs"].collect()} == {"a": ("success", 2), "b": ("success", 1), "c": ("error", 0), "d": ("error", 0), "e": ("success", 0), "f": ("error", 0)}
    states = {r.source: r.status for r in run["health"].collect()}
    assert (states["a"], states["c"], states["d"], states["e"]) == ("warming", "down", "down", "warming")
    gate = run["gate"].first()
    assert not gate.passed and gate.failed_source and not gate.quality_error
    with pytest.raises(RuntimeError, match="failed_source, degraded"):
        entries.require(run["gate"])


def test_duplicates_clusters_and_report(run):
    (pair,) = run["duplicates"].collect()
    rows = {r.external_id: (r.source, r.title) for r in run["rows"].collect()}
    assert {rows[pair.external_id_a][0], rows[pair.external_id_b][0]} == {"a", "b"}
    assert sorted(r.n for r in run["clusters"].groupBy("cluster").agg(F.count("*").alias("n")).collect()) == [1, 2]
    assert run["key_changes"].count() == 0  # the two titles have one normalised form, so one key
    report = json.loads(entries.report(run, run).first().report)
    assert (report["collected"], report["failed"], report["canonical_events"], report["multi_source_events"], report["duplicate_candidates"], report["overall"]) == (3, 3, 2, 1, 1, "degraded")
    assert [s["source"] for s in report["sources"]] == list("abcdef") and report["sources"][3]["error_text"] == "no rows"
