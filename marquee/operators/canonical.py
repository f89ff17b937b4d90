"""Canonical occurrences: rows that describe one event, as clusters.

Rows can only match within a tolerance of time, so a gap wider than that between neighbours in time ends an island, and
clustering runs island by island. With an equality key, clusters of the any-member rule are the islands of each key. Without
one, rows that match are the edges of a graph, and the order-dependent greedy rules run along the edges of each component.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..tables import Scratch, shuffled
from .graph import greedy
from .titles import similar_pairs

TOLERANCE = 15 * 60
#: Bins of counts of pairs of letters; titles whose clusters are found first.
BINS, HEAD = 256, 256
#: Words of 64 bits that tell which words a title has.
WORD_MARKS = 4


def islands(df: DataFrame, keys: list[str], ts: str, seconds: int = TOLERANCE, order: tuple[str, ...] = ()) -> DataFrame:
    """df with island: a number of the stretch of time, within its keys, that no gap over seconds cuts.

    Without keys the rows are cut into cells of that width first: no gap inside a cell is wider, so only the cells' first and
    last times are put in order, a row for each cell of time that has data, and rows are joined with their cell.
    """
    if not keys:
        micros, cell = F.unix_micros(F.col(ts).cast("timestamp")), "_cell"
        rows = df.withColumn(cell, F.floor(micros / (seconds * 1_000_000)))
        cells = rows.groupBy(cell).agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"))
        w = W.orderBy(cell)
        cut = F.when(F.col("_first") - F.lag("_last").over(w) > seconds * 1_000_000, 1).otherwise(0)
        cells = cells.withColumn("_cut", cut).withColumn("island", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
        return rows.join(cells.select(F.col(cell).alias("_of"), "island"), F.col(cell).eqNullSafe(F.col("_of"))).drop(cell, "_of")
    w = W.partitionBy(*keys).orderBy(ts, *order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    flagged = df.withColumn("_cut", F.when(gap > seconds * 1_000_000, 1).otherwise(0))
    return flagged.withColumn("island", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def clusters(df: DataFrame, keys: list[str], ts: str, id_: str, seconds: int = TOLERANCE) -> DataFrame:
    """df with cluster: the least id of its island of keys; equal to greedy any-member clustering in time order."""
    return islands(df, keys, ts, seconds, (id_,)).withColumn("cluster", F.min(id_).over(W.partitionBy(*keys, "island"))).drop("island")


def by_leader(rows: list[dict], same: Callable[[dict, dict], bool]) -> list[int]:
    """Greedy: each row joins the first cluster whose first member it matches, or opens one."""
    leaders, out = [], []
    for row in rows:
        at = next((k for k, leader in enumerate(leaders) if same(leader, row)), len(leaders))
        if at == len(leaders):
            leaders.append(row)
        out.append(at)
    return out


def by_any_member(rows: list[dict], same: Callable[[dict, dict], bool]) -> list[int]:
    """Greedy: each row joins the first cluster with any member that it matches; clusters never merge."""
    members, out = [], []
    for row in rows:
        at = next((k for k, cluster in enumerate(members) if any(same(x, row) for x in cluster)), len(members))
        if at == len(members):
            members.append([])
        members[at].append(row)
        out.append(at)
    return out


def same_occurrence(seconds: int = TOLERANCE, keyed: bool = False) -> Callable[[dict, dict], bool]:
    """Within the tolerance, titles and venues as variants (or, keyed, the same group key); undated rows match nothing."""

    def same(a: dict, b: dict) -> bool:
        if pd.isna(a["start_at"]) or pd.isna(b["start_at"]) or abs((a["start_at"] - b["start_at"]).total_seconds()) > seconds:
            return False
        return keyed and a["group_key"] == b["group_key"] or text.same_title(a["title_key"], b["title_key"]) and text.same_venue(a["venue_key"], b["venue_key"])

    return same


def _title_matches(keys: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(ord, t) of all titles of keys (t, distinct), and (first, second) of all their numbers of which the second is a variant of the first: themselves, similar ones, and those that share their words."""
    titles = scratch.cut(keys.orderBy("t").withColumn("ord", F.monotonically_increasing_id()), "keys")
    met = similar_pairs(titles, both=True, scratch=scratch).select("a", "b")
    words = scratch.cut(word_pairs(titles, scratch=scratch), "shared")
    met = met.unionByName(words).unionByName(words.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(titles.select(F.col("ord").alias("a"), F.col("ord").alias("b")))
    return titles, scratch.cut(met.select(F.col("a").alias("first"), F.col("b").alias("second")).distinct(), "matches")


def _match_edges(nodes: DataFrame, seconds: int, keyed: bool, block: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """(a, b, at_a, at_b) of nodes (ord, at, title_key, venue_key, [group_key], block) close in time, a before b, of which b is a variant of a or has its group key.

    Rows meet in cells of time: of one title's variants, by the titles' numbers, or of one group key. Venues are compared for rows whose titles match.
    """
    tolerance = seconds * 1_000_000
    cell = F.floor(F.col("at") / max(tolerance, 1))
    titles, variants = _title_matches(nodes.select(F.col("title_key").alias("t")).distinct(), scratch)
    known = nodes.join(shuffled(titles.select(F.col("ord").alias("title"), F.col("t").alias("title_key"))), "title_key").select("ord", "at", "title", "venue_key", *block)
    known = scratch.cut(known, "known")
    around = F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")
    same = [*block, "cell"]
    left = known.select(F.col("ord").alias("a"), F.col("at").alias("at_a"), F.col("title").alias("first"), F.col("venue_key").alias("venue_a"), *block, around)
    right = known.select(F.col("ord").alias("b"), F.col("at").alias("at_b"), F.col("title").alias("second"), F.col("venue_key").alias("venue_b"), *block, cell.alias("cell"))
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("at_a") - F.col("at_b")) <= tolerance)
    met = left.join(shuffled(variants), "first").join(shuffled(right), ["second", *same]).where(near)
    v, w = F.col("venue_a"), F.col("venue_b")
    plain = (v == "") | (w == "") | F.contains(v, w) | F.contains(w, v)
    close = met.where(plain | text.could_reach(v, w, 0.80)).withColumn("alike", text.sequence_ratio(F.when(~plain, v), F.when(~plain, w)))  # null is not compared
    out = scratch.cut(close.where(plain | (F.col("alike") >= 0.80)).select("a", "b", "at_a", "at_b"), "alike")
    if keyed:
        key = lambda df, side: df.select(side, f"at_{side}", *same, "group_key")
        l = nodes.select(F.col("ord").alias("a"), F.col("at").alias("at_a"), "group_key", *block, around)
        r = nodes.select(F.col("ord").alias("b"), F.col("at").alias("at_b"), "group_key", *block, cell.alias("cell"))
        own = scratch.cut(key(l, "a").join(shuffled(key(r, "b")), ["group_key", *same]).where(near).select("a", "b", "at_a", "at_b"), "keyed")
        out = out.unionByName(own).distinct()
    return out


def fuzzy_clusters(df: DataFrame, order: str, rule: str = "leader", seconds: int = TOLERANCE, block: tuple[str, ...] = (), timed: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """df (.., title, venue, start_at) with cluster, by greedy first match in the order given: the order of the cluster's first row.

    rule: leader (scraped batches) or any (stored rows, where equal group_key within the tolerance also matches). The order is
    unique; timed says that it never goes back in time, so that labels can be forgotten. block: columns whose equality any match
    implies. Undated rows are clusters of their own. Rows that agree in all that is compared are one node under leader; under
    any give each of them once.
    """
    keyed = rule == "any" and "group_key" in df.columns
    scratch = Scratch(df.sparkSession, "fuzzy", scratch)
    key = lambda c: text.normalized(c, compose=True)
    given = df.withColumns({"title_key": key(text.bare_title(F.coalesce("title", F.lit("")))), "venue_key": key(F.coalesce("venue", F.lit(""))), "at": F.unix_micros(F.col("start_at").cast("timestamp"))})
    features = ["at", "title_key", "venue_key", *block]
    every = scratch.cut(given, "rows")
    rows = every.where("start_at is not null")
    nodes = rows.select(*features, *(["group_key"] if keyed else []), F.col(order).alias("first_row")) if rule == "any" else rows.groupBy(*features).agg(F.min(order).alias("first_row"))
    nodes = scratch.cut(nodes.orderBy("first_row").withColumn("ord", F.monotonically_increasing_id()), "nodes")
    edges = _match_edges(nodes, seconds, keyed, block, scratch)
    found = greedy(edges, rule, seconds * 1_000_000 if timed else None, scratch)
    opener = nodes.select(F.col("ord").alias("opener"), F.col("first_row").cast("string").alias("cluster"))
    joined = scratch.cut(found.join(shuffled(opener), "opener").select(F.col("node").alias("ord"), "cluster"), "joined")
    named = nodes.join(shuffled(joined), "ord", "left").withColumn("cluster", F.coalesce("cluster", F.col("first_row").cast("string")))
    if rule == "any":
        out = every.join(shuffled(named.select(F.col("first_row").alias(order), "cluster")), order, "left")
    else:
        out = every.join(shuffled(named.select(*features, "cluster")), features, "left")
    return out.select(*df.columns, F.coalesce("cluster", F.concat(F.lit("undated:"), F.col(order).cast("string"))).alias("cluster"))  # no union over joins: Spark 4.1 can fail to plan one


class Titles:
    """Titles sorted by length, with binned counts of their pairs of letters and sets of their fours.

    Two strings of lengths that sum to s with m letters in common blocks have at most s - 2m + 1 blocks, so they share at least
    m - (g - 1)(s - 2m + 1) runs of g letters; bins can only raise what they seem to share. From 200 letters on, text.ratio starts
    a block only at a letter that makes up about 1 % of the second string at most, or at both starts, which bounds the blocks too.
    """

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.array([len(x) for x in texts], np.int64)
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), self.length)
        inside = owner[1:] == owner[:-1]
        bins = ((letters[:-1] * np.uint64(0x9E3779B97F4A7C15) + letters[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)) % np.uint64(BINS)
        longest = int(self.length.max(initial=0))
        kind = np.uint8 if longest < 256 else np.uint16 if longest < 65536 else np.uint32
        counts = np.bincount(owner[1:][inside] * BINS + bins[inside].astype(np.int64), minlength=len(texts) * BINS)
        self.counts = counts.reshape(len(texts), BINS).astype(kind)
        self.order = np.argsort(self.length, kind="stable")
        self.sorted, self.lengths = self.counts[self.order], self.length[self.order]
        self._fours: dict[int, set] = {}
        self._letters: dict[int, tuple[Counter, dict]] = {}

    def fours(self, k: int) -> set:
        """Runs of four letters of title k, each with the number of its occurrence."""
        if k not in self._fours:
            x, seen = self.texts[k], Counter()
            out = set()
            for i in range(len(x) - 3):
                gram = x[i : i + 4]
                out.add((gram, seen[gram]) if seen[gram] else gram)
                seen[gram] += 1
            self._fours[k] = out
        return self._fours[k]

    def letters(self, k: int) -> tuple[Counter, dict]:
        """How often title k has each letter: all, and those at which a block can start."""
        if k not in self._letters:
            all_, n = Counter(self.texts[k]), len(self.texts[k])
            self._letters[k] = all_, {c: m for c, m in all_.items() if n < 200 or m <= n // 100 + 1}
        return self._letters[k]

    def alike(self, other: Titles, k: int, least: float) -> Iterator[int]:
        """Places here of all whose fours allow the ratio with the other's title k."""
        for x in self.near(other, k, least).tolist():
            total = int(self.length[x] + other.length[k])
            m = int(np.ceil(total * least / 2 - 1e-6))
            blocks, shared = total - 2 * m + 1, None
            if m > 3 * blocks and (shared := len(self.fours(x) & other.fours(k))) < m - 3 * blocks:
                continue
            (a, a_starts), (b, b_starts) = self.letters(x), other.letters(k)
            starts = 1 + max(sum(min(n, a[c]) for c, n in b_starts.items()), sum(min(n, b[c]) for c, n in a_starts.items()))
            if starts < blocks and m > 3 * starts and (len(self.fours(x) & other.fours(k)) if shared is None else shared) < m - 3 * starts:
                continue
            yield x

    def near(self, other: Titles, k: int, least: float) -> np.ndarray:
        """Places here of all that the other's title k can reach the ratio with."""
        n = int(other.length[k])
        low, high = np.searchsorted(self.lengths, n * least / (2 - least) - 1e-6), np.searchsorted(self.lengths, n * (2 - least) / least + 1e-6, "right")
        total = self.lengths[low:high] + n
        m = np.ceil(total * least / 2 - 1e-6)
        shared = np.minimum(self.sorted[low:high], other.counts[k]).sum(axis=1, dtype=np.int64)
        return self.order[low:high][shared >= 3 * m - total - 1]


def word_pairs(titles: DataFrame, least: float = 0.85, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a before b: all pairs of titles (ord, t) of which one has least of the other's distinct words, which are three at least.

    A title of n words that shares c of them has one of any n - c + 1; its rarest are looked up in titles of as many words or more.
    Words have one of 64 WORD_MARKS bits each: titles that lack more of a title's bits than it has other words don't meet. Those
    that are left are counted in full. Words go by the number of their title: no text is repeated for each of its words.
    """
    marks, bits = [f"m{k}" for k in range(WORD_MARKS)], 64 * WORD_MARKS
    scratch = Scratch(titles.sparkSession, "titles", scratch)
    words = titles.select("ord", F.array_distinct(F.split("t", " ")).alias("w")).where("size(w) >= 3").withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    mark = lambda k: F.aggregate("h", F.lit(0).cast("long"), lambda out, h: F.when(F.shiftright(F.pmod(h, F.lit(bits)), 6) == k, out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))).otherwise(out)).alias(f"m{k}")
    words = words.select("ord", F.size("w").alias("n"), F.arrays_zip(F.col("w").alias("x"), "h").alias("w"), *map(mark, range(WORD_MARKS)))  # before each word is a row
    word = scratch.cut(words.select("ord", "n", *marks, F.explode("w").alias("w")).select("ord", "n", *marks, "w.x", "w.h"), "words")
    ranked = word.drop("x").join(shuffled(word.groupBy("h").agg(F.count("*").alias("df"))), "h")
    shared = F.ceil(F.col("n") * least - 1e-9).cast("int")
    rare = ranked.groupBy("ord", "n", *marks).agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("w"))
    rare = rare.select("ord", "n", *marks, F.explode(F.slice("w", 1, F.col("n") - shared + 1)).alias("w")).select("ord", "n", *marks, "w.h")
    l, r = rare.alias("l"), word.drop("x").alias("r")
    lacks = reduce(Column.__add__, [F.bit_count(F.col(f"l.{m}").bitwiseAND(F.bitwise_not(F.col(f"r.{m}")))) for m in marks])
    most = F.col("l.n") - F.ceil(F.col("l.n") * least - 1e-9)
    met = l.join(shuffled(r), (F.col("l.h") == F.col("r.h")) & ((F.col("l.n") < F.col("r.n")) | (F.col("l.n") == F.col("r.n")) & (F.col("l.ord") < F.col("r.ord"))) & (lacks <= most))
    met = scratch.cut(met.select(F.col("l.ord").alias("of"), F.col("l.n").alias("n"), F.col("r.ord").alias("in")).distinct(), "candidates")
    own, theirs = word.select(F.col("ord").alias("of"), "x"), word.select(F.col("ord").alias("in"), "x")
    shared = met.join(shuffled(own), "of").join(shuffled(theirs), ["in", "x"]).groupBy("of", "in", "n").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") / F.col("n") >= least).select(F.least("of", "in").alias("a"), F.greatest("of", "in").alias("b"))


def title_clusters(df: DataFrame, order: str, scratch: Scratch | None = None) -> DataFrame:
    """df (.., title) with cluster, the order of its leader: by_leader with same_title over all rows in the order given, without a block.

    Rows of one normalised title are one, with their least order. Clusters of the first titles are found first, so that a large
    group's pairs are not listed. The others' leaders follow from all pairs that match, along the edges of each component.
    """
    key = text.normalized(text.bare_title(F.coalesce("title", F.lit(""))), compose=True)
    scratch = Scratch(df.sparkSession, "titles", scratch)
    keyed = scratch.cut(df.withColumn("_t", key), "keyed")
    titles = scratch.cut(keyed.groupBy(F.col("_t").alias("t")).agg(F.min(F.col(order).cast("long")).alias("ord")), "titles")
    head = titles.orderBy("ord").limit(HEAD).collect()
    found = by_leader([{"t": r["t"], "w": set(r["t"].split())} for r in head], lambda x, y: _matches(x["t"], y["t"]))
    first = [head[found.index(k)] for k in range(max(found, default=-1) + 1)]
    ords, leaders = [r["ord"] for r in first], [r["t"] for r in first]

    @F.pandas_udf("long")
    def joined(found: pd.Series) -> pd.Series:
        """The first leader that matches; a title of the head matches none that came after it but for its own."""
        theirs, ours = Titles(leaders), Titles(found.tolist())
        words = [set(x.split()) for x in leaders]
        place = {x: k for k, x in enumerate(leaders)}
        out = []
        for k, x in enumerate(ours.texts):
            mine = set(x.split())
            hits = {place[x]} if x in place else set()
            hits.update(i for i, w in enumerate(words) if min(len(w), len(mine)) >= 3 and len(w & mine) / min(len(w), len(mine)) >= 0.85)
            hits.update(i for i in theirs.alike(ours, k, 0.90) if i < min(hits, default=len(leaders)) and text.ratio(leaders[i], x) >= 0.90)
            out.append(ords[min(hits)] if hits else None)
        return pd.Series(out, dtype="Int64")

    placed = scratch.cut(titles.repartition(_partitions(df)).withColumn("cluster", joined("t")), "placed")
    rest = placed.where("cluster is null").select("ord", "t")
    pairs = scratch.cut(similar_pairs(rest, scratch=scratch).select("a", "b").unionByName(word_pairs(rest, scratch=scratch)).distinct(), "pairs")
    found = greedy(pairs, "leader", scratch=scratch).select(F.col("node").alias("b"), F.col("opener").alias("leader"))
    named = scratch.cut(placed.join(shuffled(found), F.col("ord") == F.col("b"), "left").select("t", F.coalesce("cluster", "leader", "ord").cast("string").alias("cluster")), "named")
    scratch.keep_only(keyed, named)
    return keyed.join(shuffled(named), F.col("_t") == F.col("t")).select(*df.columns, "cluster")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _matches(a: str, b: str) -> bool:
    """text.same_title, with cheap bounds before the ratio."""
    x, y = set(a.split()), set(b.split())
    fewer = min(len(x), len(y))
    if a == b or fewer >= 3 and len(x & y) / fewer >= 0.85:
        return True
    total = len(a) + len(b)
    if 2 * min(len(a), len(b)) / max(total, 1) < 0.90:
        return False
    return 2 * (Counter(a) & Counter(b)).total() / max(total, 1) >= 0.90 and text.ratio(a, b) >= 0.90


def representatives(df: DataFrame, rule: str = "leader") -> DataFrame:
    """One row per cluster: its representative, the earliest start, and the offers sorted by source.

    leader: the longest title, then the greatest. any: the earliest start (undated last), then the longest title, then source.
    """
    row = F.struct(*[c for c in df.columns if c != "cluster"])
    offer = F.struct("source", "title", "start_at", "price_text", "ticket_url")
    if rule == "leader":
        best = F.max_by(row, F.struct(F.length("title"), F.col("title")))
    else:
        best = F.min_by(row, F.struct(F.col("start_at").isNull(), "start_at", -F.length(text.normalized(text.bare_title(F.col("title")))), "source"))
    return df.groupBy("cluster").agg(best.alias("event"), F.min("start_at").alias("start_at"), F.array_sort(F.collect_list(offer)).alias("offers"), F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"))


def duplicate_candidates(df: DataFrame, similarity: float = 0.90, seconds: int = TOLERANCE, block: tuple[str, ...] = ()) -> DataFrame:
    """(external_id_a, external_id_b, similarity) of rows of different sources, close in time, with similar titles; a before b in ord.

    Lengths are compared before any Python runs; unordered pairs of ids appear once.
    """
    from .dedupe import band_pairs, keep_first

    rows = df.where("start_at is not null").select("source", "ord", "external_id", "start_at", text.normalized(F.col("title"), compose=True).alias("t"), *block)
    pairs = band_pairs(rows, rows, "start_at", seconds, list(block)).where("l.ord < r.ord and l.source <> r.source")
    pairs = pairs.where(text.could_reach(F.col("l.t"), F.col("r.t"), similarity)).withColumn("similarity", text.sequence_ratio(F.col("l.t"), F.col("r.t"))).where(F.col("similarity") >= similarity)
    pairs = pairs.select("l.ord", F.col("r.ord").alias("ord_b"), F.col("l.external_id").alias("external_id_a"), F.col("r.external_id").alias("external_id_b"), "similarity")
    pairs = pairs.withColumn("low", F.least("external_id_a", "external_id_b")).withColumn("high", F.greatest("external_id_a", "external_id_b"))
    return keep_first(pairs, ["low", "high"], [F.col("ord"), F.col("ord_b")]).drop("low", "high")


def title_duplicates(df: DataFrame, similarity: float = 0.90, scratch: Scratch | None = None) -> DataFrame:
    """duplicate_candidates where all rows (source, ord, external_id, title) are close in time, ord and external_id unique: all pairs, without a block."""
    scratch = Scratch(df.sparkSession, "titles", scratch)
    rows = scratch.cut(df.select("source", "ord", "external_id", text.normalized(F.col("title"), compose=True).alias("t")), "rows")
    titles = scratch.cut(rows.groupBy("t").agg(F.min("ord").alias("ord")), "titles")
    pairs = scratch.cut(similar_pairs(titles, similarity, both=True, scratch=scratch), "similar")
    named = pairs.join(shuffled(titles.select(F.col("ord").alias("a"), F.col("t").alias("ta"))), "a").join(shuffled(titles.select(F.col("ord").alias("b"), F.col("t").alias("tb"))), "b").select("ta", "tb", "similarity")
    named = named.unionByName(titles.select(F.col("t").alias("ta"), F.col("t").alias("tb"), F.lit(1.0).alias("similarity")))
    met = rows.alias("l").join(shuffled(named), F.col("l.t") == F.col("ta")).join(shuffled(rows.alias("r")), F.col("r.t") == F.col("tb")).where("l.ord < r.ord and l.source <> r.source")
    return met.select("l.ord", F.col("r.ord").alias("ord_b"), F.col("l.external_id").alias("external_id_a"), F.col("r.external_id").alias("external_id_b"), "similarity")
