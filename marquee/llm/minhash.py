"""Near duplicates: minima of many universal hashes, banding, signature verification, exact check, components.

1. A document becomes its distinct shingles (as 64-bit hashes), their fingerprint, the minima of 200 universal hashes,
   40 band keys of five minima each, and the low byte of each minimum as its signature.
2. Documents with one fingerprint are one class; only the first of a class goes on, so exact copies cost one grouped minimum.
3. Within a bucket (a band key) no pairs are listed. Its leader is the member that shares most with all others (the sum of
   the sizes of its buckets); every member meets its buckets' leaders. Signatures are verified first; only for pairs that
   pass are the full sets made and compared, and components of these links are found.
4. Groups of a leader with members in different components are searched for the links that are left: members outside the
   group's largest component against all, in tiles of bounded size. A tile knows each member by how its set differs from the
   leader's, which gives exact intersections; it returns links only, one per document and component.

With similarity 0.8 a pair shares no bucket with a chance of (1 - 0.8^5)^40 = 1.3e-7. A pair (member, leader) whose signatures
agree on less than similarity - 0.18, over six standard deviations, is no link with a chance of 1 - 1e-8; if it is one, step 4
still finds it where its members end in different components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch
from .common import asked_rows, gram_hashes, hashed_documents, in_batches, mix, signed, text_key
from .components import components

HASHES, ROWS = 200, 5
SLACK = 0.18
#: Documents on either side of a tile, about.
TILE = 128
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
SKETCH = "doc_id long, key long, n_shingles long, print binary, signature binary, bands array<long>"


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles; fewer words than n make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return gram_hashes(words, len(words), salt=7)
    return np.unique(gram_hashes(words, n))


def minima(items: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(items), 4096):
        np.minimum(least, (_A[:, None] * items[None, k : k + 4096] + _B[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """least: documents x hashes."""
    rows = mix(least).reshape(len(least), -1, ROWS)
    key = np.arange(rows.shape[1], dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    for k in range(ROWS):
        key = mix(key + rows[:, :, k])
    return key


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """SKETCH of every row of docs (doc_id, text): doc_id, the key of the text, and what follows from the whole text."""

    def run(batches):
        for batch in batches:
            rows = [(k, shingles(words, n)) for k, words in hashed_documents(batch.column(1), lower=True)]
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                least = np.stack([minima(x) for _, x in part])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array([k for k, _ in part])) for c in (0, 2)),
                        pa.array([len(x) for _, x in part], pa.int64()),
                        pa.array([_print(x) for _, x in part], pa.binary()),
                        pa.array([x.tobytes() for x in least.astype(np.uint8)], pa.binary()),
                        pa.array(list(signed(band_keys(least))), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "key", "n_shingles", "print", "signature", "bands"],
                )

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")), run, SKETCH)


def _print(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, items) for docs (node, text): the sorted distinct shingles as packed 64-bit hashes."""

    def run(batches):
        for batch in batches:
            items = [shingles(words, n).tobytes() for _, words in hashed_documents(batch.column(1), lower=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.large_binary()).cast(pa.binary())], names=["node", "items"])

    return in_batches(docs.select("node", "text"), run, "node long, items binary")


def verified(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) whose signatures in marks (node, signature) agree well enough."""
    chance = 1 / 256

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
                e = ((a == b).mean(axis=1) - chance) / (1 - chance)
                keep = np.flatnonzero(e >= similarity - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["u", "v"])

    left, right = (marks.select(F.col("node").alias(k), F.col("signature").alias(f"s{k}")) for k in "uv")
    return in_batches(pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv"), run, "u long, v long")


def _compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) with how u's set differs from v's: sizes, what v has and u hasn't (missing), the symmetric difference, and whether they are linked."""
    percent = round(100 * similarity)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for a, b in zip(part.column(2), part.column(3), strict=True):
                    a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                    differ = np.setxor1d(a, b, assume_unique=True)
                    both = (len(a) + len(b) - len(differ)) // 2
                    out.append((len(a), len(b), len(b) - both, differ.tobytes(), 100 * both >= percent * (len(a) + len(b) - both)))
                columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["u", "v", "size", "leader_size", "missing", "differ", "linked"])

    asked = scratch.cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node").select("doc_id", "key", "node"), "asked")
    sets = scratch.cut(shingle_sets(asked_rows(docs, asked, ("key",)), n).dropDuplicates(["node"]), "sets")
    left, right = (sets.select(F.col("node").alias(k), F.col("items").alias(f"s{k}")) for k in "uv")
    return in_batches(pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "su", "sv"), run, "u long, v long, size long, leader_size long, missing long, differ binary, linked boolean")


def _mixed_groups(met: DataFrame, group: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of met (u, v: leader): the groups with members of more than one component, and their members with component and block."""
    member = met.join(group, F.col("u") == F.col("node"), "left").withColumn("component", F.coalesce("component", "u")).drop("node")
    parts = member.groupBy("v", "component").count()
    parts = parts.groupBy("v").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.sum("count").alias("many"), F.count("*").alias("kinds")).where("kinds > 1")
    parts = scratch.cut(parts.select("v", "main", F.expr(f"many div {TILE} + 1").alias("blocks")), "groups")  # a table, so that Spark can split a large group in the join
    return parts, scratch.cut(member.join(parts, "v").withColumn("block", F.pmod(F.xxhash64("u", "v"), F.col("blocks"))), "mixed")


def _searched(member: DataFrame, compared: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Links (u, v) between members of one leader's group that lie in different components."""
    percent = round(100 * similarity)
    member = scratch.cut(member.join(compared.drop("linked"), ["u", "v"]), "searched")
    every = F.expr("explode(sequence(0L, blocks - 1))")
    columns = ("v", "u", "size", "leader_size", "missing", "differ", "component")
    # as many blocks of those that ask as of those that are asked: a tile is one of each
    asking = member.where("component <> main").select(*columns, F.col("block").alias("row"), every.alias("column"), F.lit(True).alias("asks"))
    rows = scratch.cut(asking.select("v", "row").distinct().groupBy("v").agg(F.collect_set("row").alias("rows")), "rows")
    asked = member.join(rows, "v").select(*columns, F.explode("rows").alias("row"), F.col("block").alias("column"), F.lit(False).alias("asks"))

    def tile(pdf):
        import pandas as pd

        asks, all_ = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        found = []
        if len(asks) and len(all_):
            sets = [np.frombuffer(x, np.uint64) for x in all_["differ"]]
            items, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            size, missing, ids, component = (all_[c].to_numpy() for c in ("size", "missing", "u", "component"))
            for q in asks.itertuples():
                mine = np.frombuffer(q.differ, np.uint64)
                low, high = np.searchsorted(items, mine, "left"), np.searchsorted(items, mine, "right")
                n = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, np.int64)
                common = np.bincount(owner[at], minlength=len(ids))
                both = q.leader_size - q.missing - missing + common
                for k in np.flatnonzero((100 * both >= percent * (q.size + size - both)) & (component != q.component)):
                    found.append((q.u, ids[k], component[k]))
        out = pd.DataFrame(found, columns=["u", "v", "component"])
        return out.groupby(["u", "component"], as_index=False)["v"].min()[["u", "v"]].astype("int64") if len(out) else out[["u", "v"]].astype("int64")

    return asking.unionByName(asked).groupBy("v", "row", "column").applyInPandas(tile, "u long, v long")


def _classes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(print, doc_id, key, node) of prints (doc_id, print, key): its least doc_id stands for a fingerprint and is its node.

    Where ids repeat with other texts, one id can stand for two fingerprints: the least is the id's, the others' nodes are
    numbers above all ids.
    """
    least = prints.groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    found = scratch.cut(prints.join(least, ["print", "doc_id"]), "least")
    twice = scratch.cut(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("print").alias("own")).where("n > 1"), "twice")
    if twice.isEmpty():
        return found.withColumn("node", F.col("doc_id"))
    top = prints.agg(F.max("doc_id")).first()[0]
    shared = F.col("own").isNotNull() & (F.col("own") != F.col("print"))
    return scratch.cut(found.join(twice, "doc_id", "left").withColumn("node", F.when(shared, top + 1 + F.monotonically_increasing_id()).otherwise(F.col("doc_id"))).drop("n", "own"), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, scratch: Scratch | None = None, keyed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...).

    Words are runs of other than the six white-space characters, A-Z folded. Two documents are linked if the Jaccard
    similarity of their shingle sets reaches similarity; component_id is the least doc_id that can be reached.
    A document with fewer words than a shingle is one shingle; one without words (empty or null) is linked with nothing.
    Texts of any length are read whole. Rows with a null doc_id can't be linked or named: component_id is null and kept is true.
    Rows that repeat a doc_id each get a row, and are documents of their own: each is linked by its own text. keyed adds key,
    the common.text_key of a row's text, which tells such rows apart, and group, a number of the component (null without words),
    as two components can have one least doc_id then. Other columns of docs are ignored; an empty table gives
    an empty result.
    """
    scratch = Scratch(docs.sparkSession, "near-duplicates", scratch)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    marks = scratch.cut(sketches(docs, shingle), "sketches")  # bands and signatures; the last join reads four columns of it
    whole = marks.where("n_shingles > 0 and doc_id is not null")
    prints = scratch.cut(whole.groupBy("doc_id", "print").agg(F.min("key").alias("key")), "prints")
    classes = scratch.cut(_classes(prints, scratch), "classes")
    first = scratch.cut(whole.join(classes, ["print", "doc_id", "key"]).select("node", "bands", "signature").dropDuplicates(["node"]), "first")
    member = first.select("node", F.explode("bands").alias("bucket"))
    sizes = scratch.cut(member.groupBy("bucket").count().where("count > 1"), "buckets")
    member = scratch.cut(member.join(sizes, "bucket"), "members")
    central = member.groupBy("node").agg(F.sum("count").alias("central"))
    leaders = member.join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", (-F.col("node")).alias("minus")))["minus"].alias("minus"))
    leaders = scratch.cut(leaders.select("bucket", (-F.col("minus")).alias("v")), "leaders")
    met = scratch.cut(member.join(leaders, "bucket").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "met")
    near = scratch.cut(verified(met, first, similarity), "near")
    scratch.keep_only(marks, prints, classes, met, near)
    compared = scratch.cut(_compared(near, docs, classes, shingle, similarity, scratch), "compared")
    links = scratch.cut(compared.where("linked").select("u", "v"), "links")
    group = components(links, scratch)
    parts, mixed = _mixed_groups(met, group, scratch)
    scratch.keep_only(marks, prints, classes, links, compared, parts, mixed)
    rest = scratch.cut(mixed.select("u", "v").join(compared.select("u", "v"), ["u", "v"], "left_anti"), "rest")
    known = compared.unionByName(_compared(rest, docs, classes, shingle, similarity, scratch))
    links = scratch.cut(links.unionByName(known.where("linked").join(rest, ["u", "v"], "left_semi").select("u", "v")).unionByName(_searched(mixed, known, similarity, scratch)), "links")
    group = components(links, scratch)

    named = scratch.cut(classes.join(group, "node", "left").select("print", "doc_id", F.coalesce("component", "node").alias("component")), "named")
    least = scratch.cut(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "components")
    named = named.join(least, "component").select("print", "component_id", "component")
    named = scratch.cut(prints.select("doc_id", "print").join(named, "print").select(F.col("doc_id").alias("id"), F.col("print").alias("of"), "component_id", "component"), "named")
    out = scratch.cut(marks.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("print")).alias("print")), "rows")
    scratch.keep_only(out, named)
    return (
        out.join(named, (F.col("doc_id") == F.col("id")) & (F.col("print") == F.col("of")), "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["key", F.col("component").alias("group")] if keyed else []))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
