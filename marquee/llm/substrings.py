"""Passages that repeat across documents, by level-wise doubling, and their removal.

A level looks at windows of one length, and only those found in two documents are extended to twice that length, until no
candidates survive.

Levels below the length asked for (25 of 50 words; 25, 50 and 100 of 200). Of the short windows inside each full window only
the one with the least hash has to be counted: equal full windows hold equal short windows, so they choose the same one. A
run is a stretch of consecutive full windows with one chosen short window (its anchor). Runs whose anchor is in one document
only fall away, and the next level reads only the documents and the windows that are left.

The level of the full length. Runs with equal words, at the same place around the anchor, hold equal windows: of these the
document with the least doc_id stands for all others, whose windows are all covered. Only the windows of these first runs
are listed and counted one by one. This level decides what is removed: longer windows add nothing to remove.

Levels beyond (repeated_lengths) tell how long the repeated passages are. Two neighbouring stretches that are each found in
two documents make one of about twice the length; those found in two documents go on, and the last level that has one ends it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Scratch
from .common import asked_rows, buffers, free_names, gram_hashes, hashed_documents, in_batches, mix, signed, text_key

#: Levels start at half the length or at the last half that has so many words at least.
SHORTEST = 25
RUN = "doc_id long, key long, anchor long, context long, first int, n int"


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the first level to length, each half of the next, rounded up."""
    out = [length]
    while out[0] > 1 and (len(out) == 1 or out[0] >= 2 * shortest):
        out.insert(0, -(-out[0] // 2))
    return out


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each width consecutive numbers, the last of equal ones."""
    m = len(x) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    pos, span = np.arange(len(x)), 1
    while span < width:  # pos[i] is the place of the least of x[i : i + span]
        step = min(span, width - span)
        a, b = pos[: len(pos) - step], pos[step:]
        pos, span = np.where(x[b] <= x[a], b, a), span + step
    return pos[:m]


def runs(words: np.ndarray, length: int, part: int, windows: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchor (a window of part words), context, first window and number of windows of each run of a document.

    windows: the full windows that are still candidates, sorted; all without it.
    """
    grams = gram_hashes(words, part, salt=part)
    at = sliding_argmin(grams, length - part + 1)
    where = np.arange(len(at)) if windows is None else windows[windows < len(at)]
    if not len(where):
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = at[where]
    edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1))))
    first, anchor = where[edge], at[edge]
    n = np.diff(np.concatenate((edge, [len(at)])))
    context = grams[anchor]
    for step in range(0, length, part):  # windows of part words from both ends cover the words of a run
        context = mix(context * np.uint64(3) + grams[np.minimum(first + step, first + n - 1 + length - part)])
        context = mix(context * np.uint64(5) + grams[np.maximum(first + n - 1 + length - part - step, first)])
    context = mix(context + (anchor - first).astype(np.uint64) * np.uint64(1 << 32) + n.astype(np.uint64))
    return grams[anchor], context, first.astype(np.int32), n.astype(np.int32)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... first + n - 1 of each."""
    first, n = first.astype(np.int64), n.astype(np.int64)
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _spans(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """first and n of each row's list of spans; a null is an empty list. The lists are not made into Python objects."""
    at, given = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    first, n = (column.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    for k in range(len(column)):
        low, high = (at[k], at[k + 1]) if given[k] else (0, 0)
        yield first[low:high], n[low:high]


def _listed(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n")).alias("spans"))  # spans of one document: no more than it has words


def _with_spans(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text, key, spans) of the documents that have spans; texts of others stay out of the shuffle as far as a bounded mask tells them apart."""
    return asked_rows(docs, scratch.cut(_listed(spans), "lists"), ("key",)).select("doc_id", "text", "key", "spans")


def document_runs(docs: DataFrame, length: int, part: int) -> DataFrame:
    """RUN of docs (doc_id, text, key) or (doc_id, text, key, spans of candidates)."""
    limited = "spans" in docs.columns

    def run(batches):
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            spans = list(_spans(batch.column(3))) if limited else None
            found = [(k, *runs(words, length, part, np.unique(_spread(*spans[k])) if limited else None)) for k, words in hashed_documents(batch.column(1)) if len(words) >= length]
            if found:
                of, n = [x[0] for x in found], [len(x[1]) for x in found]
                cols = [np.concatenate([x[i] for x in found]) for i in (1, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x[of], n)) for x in (ids, keys)] + [pa.array(signed(c)) for c in cols], names=["doc_id", "key", "anchor", "context", "first", "n"])

    return in_batches(docs, run, RUN)


def window_rows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, key, at, window, proof) of the windows in the spans of docs (doc_id, text, key, spans); window and proof are two hashes of the words."""

    def run(batches):
        for batch in batches:
            ids, keys, spans = *(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2)), list(_spans(batch.column(3)))
            found = []
            for k, words in hashed_documents(batch.column(1)):
                at = np.unique(_spread(*spans[k]))
                at = at[at <= len(words) - length]
                found.append((np.full(len(at), ids[k]), np.full(len(at), keys[k]), at.astype(np.int32), signed(gram_hashes(words, length)[at]), (gram_hashes(words, length, salt=99)[at] >> np.uint64(33)).astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in range(5)], names=["doc_id", "key", "at", "window", "proof"])

    return in_batches(docs, run, "doc_id long, key long, at int, window long, proof int")


def _in_two(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys found in two documents, with the least doc_id."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select(*keys, "low")


def _candidates(docs: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Runs whose anchor is in two documents at every level below length. Each level reads what the one before has left."""
    found = None
    for part in levels(length)[:-1] or [length]:
        given = docs if found is None else _with_spans(docs, found.select("doc_id", "key", "first", "n"), scratch)
        seen = scratch.cut(document_runs(given, length, part), "runs")
        anchors = scratch.cut(_in_two(seen, "anchor").select("anchor"), "anchors")  # a table, so that Spark can split hot keys in the join
        found = scratch.cut(seen.join(anchors, "anchor", "left_semi"), "candidates")
        scratch.keep_only(found)
        if found.isEmpty():
            break
    return found


def repeated_spans(docs: DataFrame, length: int = 50, scratch: Scratch | None = None, lengths: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, key, first, n): n consecutive windows from word first whose words also start in a document with a smaller doc_id.

    With lengths also repeated_lengths of the documents, else None. Both are tables of scratch.
    """
    scratch = Scratch(docs.sparkSession, "repeated", scratch)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key")).where("doc_id is not null")
    found = _candidates(docs, length, scratch)
    same = scratch.cut(_in_two(found, "context", "anchor"), "contexts")
    found = scratch.cut(
        found.join(same, ["context", "anchor"], "left").select("doc_id", "key", "first", "n", F.when(F.col("low").isNotNull(), F.xxhash64("context", "anchor")).alias("id"), F.coalesce(F.col("low") < F.col("doc_id"), F.lit(False)).alias("covered")),
        "runs",
    )
    windows = scratch.cut(window_rows(_with_spans(docs, found.where("not covered").select("doc_id", "key", "first", "n"), scratch), length), "windows")
    least = scratch.cut(_in_two(windows, "window", "proof"), "least")
    more = windows.join(least, ["window", "proof"]).where("low < doc_id").select("doc_id", "key", F.col("at").alias("first"), F.lit(1).alias("n"))
    spans = scratch.cut(found.where("covered").select("doc_id", "key", "first", "n").unionByName(more), "spans")
    scratch.keep_only(found, spans)
    reach = repeated_lengths(found.where("id is not null").select("doc_id", "key", "first", (F.col("first") + F.col("n")).alias("end"), "id"), length, scratch) if lengths else None
    scratch.keep_only(spans, *([reach] if lengths else []))
    return spans, reach


def repeated_lengths(stretches: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(doc_id, key, longest): words of the longest stretch of 1, 2, 4, ... neighbouring runs that is also in another document, by doubling.

    stretches: (doc_id, key, first, end, id), windows first to end - 1, each found in two documents; id names its words.
    """
    own = Scratch(scratch.spark, "lengths", scratch)
    at, reach = own.cut(stretches.dropDuplicates(["doc_id", "key", "first"]), "stretches"), []
    while not at.isEmpty():
        reach.append(own.cut(at.groupBy("doc_id", "key").agg((F.max(F.col("end") - F.col("first")) - 1 + length).cast("long").alias("longest")), "reach"))
        right = at.select("doc_id", "key", F.col("first").alias("end"), F.col("end").alias("to"), F.col("id").alias("then"))
        twice = own.cut(at.join(right, ["doc_id", "key", "end"]).select("doc_id", "key", "first", F.col("to").alias("end"), F.xxhash64("id", "then").alias("id")), "twice")
        own.keep_only(twice, *reach)
        kept = own.cut(_in_two(twice, "id").select("id"), "in-two")
        at = own.cut(twice.join(kept, "id", "left_semi"), "stretches")
        own.keep_only(at, *reach)
    every = reach[0] if reach else scratch.spark.createDataFrame([], "doc_id long, key long, longest long")
    for more in reach[1:]:
        every = every.unionByName(more)
    found = scratch.cut(every.groupBy("doc_id", "key").agg(F.max("longest").alias("longest")), "longest")
    own.close()
    return found


def words_kept(column: pa.Array, spans: Iterator[tuple[np.ndarray, np.ndarray]], length: int) -> Iterator[tuple[int, int, bytes]]:
    """Number of words, number of words removed, and the kept words joined by one space, of each text."""
    data, offsets = buffers(column)
    for k, (first, n) in enumerate(spans):
        words = data[offsets[k] : offsets[k + 1]].tobytes().split()
        if len(first):
            drop = np.zeros(len(words) + 1, np.int64)
            np.add.at(drop, first, 1)
            np.add.at(drop, np.minimum(first + n - 1 + length, len(words)), -1)
            keep = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
            yield len(words), len(words) - len(keep), b" ".join([words[i] for i in keep.tolist()])
        else:
            yield len(words), 0, b" ".join(words)


def substring_dedup(docs: DataFrame, length: int = 50, keep: tuple[str, ...] = (), scratch: Scratch | None = None, lengths: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, text, columns named by keep): every document without the words that a repeated window covers.

    A window is length consecutive words of one document; it repeats if a document with a smaller doc_id holds the same
    words in the same order, as the input has them. Where anything is removed, text is the kept words joined by one space;
    elsewhere it is the text as it came. A null text has no words and stays null; a null doc_id is neither a source nor
    changed. Texts of any length are read whole; a batch holds one text at least. Rows that repeat a doc_id don't remove each
    other, and each loses what its own text repeats (doc_id and common.text_key name a row's spans). Columns that keep doesn't name are ignored; an empty table gives an empty result.
    lengths adds the column longest (see repeated_lengths; 0 for none).
    """
    names = [f"c{k}" for k in range(len(keep))] + ["longest"] * lengths

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            counts = list(words_kept(texts, _spans(batch.column(2)), length))
            text = pa.array([t.decode() for _, _, t in counts])
            text = pc.if_else(pa.array([r > 0 for _, r, _ in counts], pa.bool_()), text.cast(texts.type), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in counts], pa.int64()), pa.array([r for _, r, _ in counts], pa.int64()), text, *batch.columns[3:]], names=["doc_id", "n_words", "n_removed", "text", *names])

    scratch = Scratch(docs.sparkSession, "substrings", scratch)
    spans, reach = repeated_spans(docs, length, scratch, lengths)
    lists = _listed(spans)
    if lengths:
        lists = lists.join(reach, ["doc_id", "key"], "full")  # here, as what is joined after the texts moves them once more
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=False))).join(lists, ["doc_id", "key"], "left")
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, n_words long, n_removed long, text string", *(f"`{n}` {kinds[c]}" for c, n in zip(keep, names, strict=False)), *["longest long"] * lengths])
    rest = [F.coalesce("longest", F.lit(0).cast("long")).alias("longest")] if lengths else []
    out = in_batches(given.select("doc_id", "text", "spans", *names[: len(keep)], *rest), run, schema)
    return out.select("doc_id", "n_words", "n_removed", "text", *(F.col(n).alias(c) for c, n in zip(keep, names, strict=False)), *names[len(keep) :])


def kept_digest(cleaned: DataFrame) -> DataFrame:
    """substring_dedup's rows with kept_sha256 for text: the digest of the kept words joined by one space."""
    (digest,) = free_names(cleaned.columns, "kept_sha256")
    more = cleaned.columns[4:]

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(3))
            found = [hashlib.sha256(b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split())).hexdigest() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found), *batch.columns[4:]], names=["doc_id", "n_words", "n_removed", digest, *more])

    kinds = dict(cleaned.dtypes)
    return in_batches(cleaned, run, ", ".join([f"doc_id long, n_words long, n_removed long, {digest} string", *(f"`{c}` {kinds[c]}" for c in more)]))
