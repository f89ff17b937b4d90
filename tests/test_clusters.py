"""Clusters by title, time and venue against plain loops; similar titles against all pairs; components."""

import hashlib
import random
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import canonical, graph, titles
from marquee.plans import entries, queries
from tests.test_engine import _titles

ratio, same_title, same_venue = cache(text.ratio), cache(text.same_title), cache(text.same_venue)


def loop(rows, any_member):
    """rows: (key, title_key, minute, venue_key, group_key) in order."""

    def same(a, b):
        if abs(a[2] - b[2]) > 15:
            return False
        return any_member and a[4] == b[4] or same_title(a[1], b[1]) and same_venue(a[3], b[3])

    clusters = []
    for r in rows:
        at = next((c for c in clusters if any(same(x, r) for x in (c if any_member else c[:1]))), None)
        if at is None:
            clusters.append([r])
        else:
            at.append(r)
    return {frozenset(x[0] for x in c) for c in clusters}


def groups(rows):
    out = defaultdict(set)
    for key, cluster in rows:
        out[cluster].add(key)
    return {frozenset(x) for x in out.values()}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rng = random.Random(9)
    some = _titles(11)[:240]
    texts = [rng.choice(some) if rng.random() < 0.7 else some[k % 7] for k in range(2000)]
    rows = [(k, f"{x}\nrest", "s" * rng.randint(1, 4)) for k, x in enumerate(texts)] + [(2000, None, "s"), (2001, "", "ss"), (2002, "!!", None)]
    folder = tmp_path_factory.mktemp("documents")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def keyed(spark, folder):
    key = lambda c: text.normalized(F.coalesce(c, F.lit("")), True)
    docs = queries.listings(spark.read.parquet(f"{folder}/documents.parquet"))
    return docs.select("ord", key(text.bare_title(F.coalesce("title", F.lit("")))).alias("t"), F.minute("start_at").alias("m"), key(F.col("venue")).alias("v"), F.md5("title").alias("g"), "start_at", "title", F.coalesce("venue", F.lit("")).alias("venue")).collect()


def test_leader_clusters_of_dense_listings(spark, documents):
    rows = sorted(keyed(spark, documents), key=lambda r: r.ord)
    want = loop([(r.ord, r.t, r.m, r.v, r.g) for r in rows], False)
    assert groups(queries.canonical_fuzzy_leader(spark, documents).collect()) == want
    assert len(rows) == 2002 and 100 < len(want) < 1900 and max(map(len, want)) > 20


def test_any_member_clusters_of_dense_listings(spark, documents):
    rows = sorted(keyed(spark, documents), key=lambda r: (r.start_at, r.title.encode(), r.venue.encode(), r.g))
    want = loop([(r.ord, r.t, r.m, r.v, r.g) for r in rows], True)
    assert groups(queries.canonical_fuzzy_any(spark, documents).collect()) == want
    assert want != loop([(r.ord, r.t, r.m, r.v, r.g) for r in rows], False)


def test_no_row_is_listed_with_its_copies(spark):
    """A third of all rows are copies of one; they are one node, and edges don't grow with them."""
    rows = [(k, "Гурт Океан Ельзи" if k % 3 else f"Вечір {k}", "Зал", "2026-08-01 18:00:00", "k") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, title string, venue string, start string, group_key string").withColumn("start_at", F.col("start").cast("timestamp_ntz")).drop("start")
    seen = []
    cut = entries.canonical.greedy
    try:
        entries.canonical.greedy = lambda edges, *a, **b: seen.append(edges.count()) or cut(edges, *a, **b)
        found = groups(entries.fuzzy(df.where("id % 3 <> 0 or id < 30")).select("id", "cluster").collect())
    finally:
        entries.canonical.greedy = cut
    assert seen[0] < 200 and max(map(len, found)) >= 2000


@pytest.mark.parametrize("both", [False, True])
def test_similar_titles_against_all_pairs(spark, both):
    rng = random.Random(4)
    some = {x.lower() for x in _titles(3)[:150]} | {"", "a", "ab", "abc", "abcd", "abcde", "abcdx", "aaaa aaaa", "aaaa aaab", "😀 гурт 😀", "😀 гурт 😁"}
    for n in (190, 199, 200, 205, 240, 420):  # around the length from which frequent letters start no block
        base = "".join(rng.choices("abcdefgh ", k=n)) + "".join(rng.choices("qxyz0123", k=6))
        for share in (0, 12, 20, 30, 60):
            letters = list(base)
            for k in rng.sample(range(len(letters)), len(letters) // share if share else 0):
                letters[k] = rng.choice("abcdxyz ")
            some.add("".join(letters))
        some |= {base[: n * 9 // 10], base[n // 2 :] + base[: n // 2], "w" * 19 + base}
    some = rng.sample(sorted(some), len(some))
    df = spark.createDataFrame(list(enumerate(some)), "ord long, t string")
    want = {(i, j): ratio(some[i], some[j]) for i in range(len(some)) for j in range(len(some)) if (i < j or both and i != j) and some[i] and some[j] and ratio(some[i], some[j]) >= 0.9}
    got = {(r.a, r.b): r.similarity for r in titles.similar_pairs(df, both=both).collect()}
    assert got == want and len(want) > 60
    assert titles.similar_pairs(df.where("false")).count() == 0 and titles.similar_pairs(df.where("t = ''")).count() == 0


def test_similar_titles_at_another_bound(spark):
    some = sorted({x.lower() for x in _titles(8)[:120]})
    df = spark.createDataFrame(list(enumerate(some)), "ord long, t string")
    want = {(i, j) for i in range(len(some)) for j in range(i + 1, len(some)) if ratio(some[i], some[j]) >= 0.75}
    assert {(r.a, r.b) for r in titles.similar_pairs(df, 0.75).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 540)] + [(7, 7), (600, 601), (601, 600)]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_greedy_along_edges(spark):
    edges = [(1, 2), (2, 3), (1, 4), (3, 4), (10, 12), (11, 12), (12, 13)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, graph.greedy(df, "any").collect())) == {2: 1, 3: 1, 4: 1, 12: 10, 13: 10}
    assert dict(map(tuple, graph.greedy(df, "leader").collect())) == {2: 1, 4: 1, 12: 10}
    assert graph.greedy(df.where("false"), "any").count() == 0


def test_growing_tables_are_never_broadcast(spark, tmp_path):
    """Spark takes the runs of titles, and packed pairs, for few bytes: a broadcast of them took more than a driver holds."""
    some = spark.createDataFrame(list(enumerate(sorted({x.lower()[:150] for x in _titles(5)[:60]}))), "ord long, t string")
    plans = []
    cut = titles.Scratch.cut
    try:
        titles.Scratch.cut = lambda self, df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or cut(self, df, name)
        pairs = titles.similar_pairs(some)
        words = canonical.word_pairs(some)
        nodes = graph.components(pairs)
    finally:
        titles.Scratch.cut = cut
    plans += [(k, df._jdf.queryExecution().executedPlan().toString()) for k, df in (("pairs", pairs), ("words", words), ("nodes", nodes))]
    assert {"met", "large", "pairs", "words"} <= {k for k, _ in plans}
    assert [k for k, plan in plans if "BroadcastHashJoin" in plan and k in ("met", "large", "pairs", "words", "nodes")] == []


def test_frequent_runs_are_not_indexed(spark):
    """Titles that begin with one word don't all meet: lists of the queries' titles grew with the square of the users."""
    some = [f"signup {hashlib.md5(str(k).encode()).hexdigest()}" for k in range(1500)]
    some += [f"{x}q" for x in some[:40]]
    df = spark.createDataFrame(list(enumerate(some)), "ord long, t string")
    rare = titles._rare(titles._measured(df, 0.9), 0.9)
    assert rare.groupBy("h").count().agg(F.max("count")).first()[0] < 80
    assert {(r.a, r.b) for r in titles.similar_pairs(df).collect()} == {(k, 1500 + k) for k in range(40)}


@pytest.mark.parametrize(("short", "both"), [(True, False), (False, True)])
def test_tiles_find_what_the_index_finds(spark, short, both):
    """Sentences of one language meet in tiles; blocks are small here, so that pairs lie within and across blocks and bands."""
    rng = random.Random(6)
    parts = ("the", "in", "thon", "an", "ble", "ea", "ti", "er", "hand", "on", "zq", "xk")
    sentence = lambda n: " ".join("".join(rng.choices(parts[:10], k=rng.randint(1, 3))) for _ in range(n))
    some = {"a", "ab", "abc", "abcd", "abcde", "abcdx"}
    for n in [rng.randint(2, 30) for _ in range(60)] + ([] if short else [rng.randint(30, 60) for _ in range(25)]):
        base = sentence(n)
        some.add(base)
        for share in (10, 15, 25):
            letters = list(base)
            for k in rng.sample(range(len(letters)), len(letters) // share):
                letters[k] = rng.choice(("", "q", "ä", "th"))
            some.add("".join(letters))
    some = rng.sample(sorted(some - {""}), len(some - {""}))
    df = spark.createDataFrame(list(enumerate(some)), "ord long, t string")
    want = {(i, j): ratio(some[i], some[j]) for i in range(len(some)) for j in range(len(some)) if (i < j or both and i != j) and 2 * min(len(some[i]), len(some[j])) >= 0.9 * (len(some[i]) + len(some[j])) - 1e-6 and ratio(some[i], some[j]) >= 0.9}
    before = titles.TILE_TITLES
    try:
        titles.TILE_TITLES = 20
        got = [titles.similar_pairs(df, both=both, tiles=tiles).collect() for tiles in (True, False)]
    finally:
        titles.TILE_TITLES = before
    assert all({(r.a, r.b): r.similarity for r in rows} == want and len(rows) == len(want) for rows in got) and len(want) > 60


def test_titles_choose_tiles_or_the_index(spark):
    """Titles of one language list more by their runs than there is to compare; titles of hashes list next to nothing."""
    rng = random.Random(2)
    syllables = [a + b for a in "bcdfgh" for b in "aeiou"]
    sentences = [" ".join("".join(rng.choices(syllables, k=2)) for _ in range(16)) for _ in range(1500)]
    hashes = [f"signup {hashlib.md5(str(k).encode()).hexdigest()}" for k in range(6000)]
    for some, tiles in ((sentences, True), (hashes, False)):
        measured = titles._measured(spark.createDataFrame(list(enumerate(some)), "ord long, t string"), 0.9).cache()
        bands = {r.band: (r.n, r.letters) for r in measured.groupBy("band").agg(F.count("*").alias("n"), F.sum("n").alias("letters")).collect()}
        assert titles._tiles_are_less(measured, bands, set(), 0.9) is tiles


def test_no_text_is_repeated_for_its_words_or_pairs(spark, tmp_path):
    """A title's whole text went with each of its words, and with each row that matches: with the square of its length."""
    some = [f"{'слово%d ' % (k % 9) * 3}{' '.join(f'w{i}' for i in range(400))} {k}" for k in range(12)]
    df = spark.createDataFrame([(k, x, "Зал", "2026-08-01 18:00:00") for k, x in enumerate(some)], "ord long, title string, venue string, start string").withColumn("start_at", F.col("start").cast("timestamp_ntz"))
    tables = []
    cut = canonical.Scratch.cut
    try:
        canonical.Scratch.cut = lambda self, df, name: tables.append((name, df.columns)) or cut(self, df, name)
        found = groups(canonical.fuzzy_clusters(df, "ord").select("ord", "cluster").collect())
    finally:
        canonical.Scratch.cut = cut
    assert found == {frozenset(range(12))}
    assert {"words", "shared", "matches"} <= {name for name, _ in tables}
    assert [name for name, columns in tables if {"t", "first", "second"} & set(columns) and name not in ("keys", "measured", "matches")] == []


def test_lists_broadcast_rows_of_the_list_only(spark, tmp_path):
    """weekend_list failed by the driver's memory: pairs of titles were broadcast. What is broadcast now is a total or the rows that are shown."""
    tables = []
    cut = titles.Scratch.cut
    try:
        titles.Scratch.cut = lambda self, df, name: tables.append((name, df._jdf.queryExecution().executedPlan().toString())) or cut(self, df, name)
        queries.weekend_list(spark, "/root/testdata/sf0.001").collect()
    finally:
        titles.Scratch.cut = cut
    assert len(tables) > 10 and [name for name, plan in tables if "BroadcastHashJoin" in plan] == []


def test_executed_lists_broadcast_rows_of_the_list_only(spark):
    """The same of the plans as they ran, the result's own among them: Spark chooses joins anew while a query runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in _each(store.executionsList())}
    queries.weekend_list(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    rows = []
    for k in {e.executionId() for e in _each(store.executionsList())} - before:
        values = store.executionMetrics(k)
        made = [m for node in _each(store.planGraph(k).allNodes()) if node.name() == "BroadcastExchange" for m in _each(node.metrics()) if m.name() == "number of output rows"]
        rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in made if values.contains(m.accumulatorId())]
    assert rows and max(rows) <= entries.SHOWN


def _each(seq):
    """The items of a Scala Seq."""
    return [seq.apply(k) for k in range(seq.size())]


def test_letters_in_order_and_in_blocks():
    rng = random.Random(3)
    matcher = titles.SequenceMatcher(None)
    for k in range(300):
        x = "".join(rng.choices("abcd é😀"[: rng.randint(1, 7)], k=rng.randint(0, 40) if k % 3 else rng.randint(190, 330)))
        y = "".join(c for c in x if rng.random() < 0.9) + "ab" if k % 2 else "".join(rng.choices("abcd", k=rng.randint(0, 40)))
        row = [0] * (len(y) + 1)
        for c in x:
            before = row
            row = [0]
            for j, e in enumerate(y):
                row.append(before[j] + 1 if c == e else max(before[j + 1], row[j]))
        assert titles.in_order(x, y) == row[-1]
        want = sum(block.size for block in titles.SequenceMatcher(None, x, y).get_matching_blocks())
        assert want <= row[-1] and titles.matched(matcher, x, y, 0) == want == titles.matched(matcher, x, y, want) and titles.matched(matcher, x, y, want + 1) is None


def test_tiles_take_bits_and_leave_few_pairs(spark):
    """Each tile had the texts of its titles, and each pair of a length was counted by itself."""
    rng = random.Random(7)
    syllables = [a + b for a in "bcdfgh" for b in "aeiou"]
    sentence = lambda n: " ".join("".join(rng.choices(syllables, k=2)) for _ in range(n))
    some = [sentence(n) for n in (8, 16, 33, 60) for _ in range(300)]
    some += [f"{x}q" for x in some[::20]]
    measured = titles._measured(spark.createDataFrame(list(enumerate(some)), "ord long, t string"), 0.9).cache()
    bands = {r.band: (r.n, r.letters) for r in measured.groupBy("band").agg(F.count("*").alias("n"), F.sum("n").alias("letters")).collect()}
    met = titles._tiled(measured, bands, 0.9, False, True, True)
    found = [(r.a, r.b) for r in met.collect()]
    assert met.columns == ["a", "b", "starts", "ways"] and len(set(found)) == len(found) < 1000
    assert set(found) >= {(20 * k, 1200 + k) for k in range(60)}


def test_titles_of_frequent_words_meet_only_where_they_may_match(spark):
    """Titles of a few frequent words were listed with each other: with the square of the titles."""
    rng = random.Random(8)
    common = [f"w{k}" for k in range(60)]
    some = [" ".join(rng.sample(common, rng.choice((3, 4, 9, 14, 20)))) for _ in range(800)]
    words = [set(x.split()) for x in some]
    tables = {}
    cut = canonical.Scratch.cut
    try:
        canonical.Scratch.cut = lambda self, df, name: tables.setdefault(name, cut(self, df, name))
        got = {(r.a, r.b) for r in canonical.word_pairs(spark.createDataFrame(list(enumerate(some)), "ord long, t string")).collect()}
    finally:
        canonical.Scratch.cut = cut
    want = {(i, j) for i in range(800) for j in range(i + 1, 800) if len(words[i] & words[j]) / min(len(words[i]), len(words[j])) >= 0.85}
    assert got == want and len(want) > 100
    assert tables["candidates"].count() < 3 * len(want)


@pytest.mark.parametrize("name", ["canonical_fuzzy_leader", "canonical_fuzzy_titles"])
def test_queries_count_the_words_of_few_pairs(spark, name):
    """All pairs of titles that share three of their words were counted in full."""
    counted = {}
    cut = canonical.Scratch.cut

    def kept(self, df, name):
        out = cut(self, df, name)
        if name == "candidates":
            counted[name] = out.count()
        return out

    try:
        canonical.Scratch.cut = kept
        rows = getattr(queries, name)(spark, "/root/testdata/sf0.001").count()
    finally:
        canonical.Scratch.cut = cut
    assert rows == 200 and counted["candidates"] < rows
