"""Maximal runs of words with a period, by Main and Lorentz's divide and conquer, and their collapse to one period.

A run is a stretch of words in which words p apart are equal, p being the smallest such number, that is at least twice as long
as p and that no neighbouring word extends. All texts of a block are one sequence of interned word ids, with a separator of
its own after each text, so nothing crosses from one text into the next.

Every text is halved again and again; all segments of one level are worked at once. A run that crosses the middle m of the
smallest segment that holds it has p words on one side of m, so the words m and m + p, or m - p and m, belong to it: the
Z-function of what starts at m, read at every p, and that of what ends before m, tell how far both equal what is p words away. Where the two values together reach p, they are the run's ends. Most Z-values are 0, as one comparison of words
shows; of the rest, those whose sum can't reach p fall away by one comparison of running hashes, and the others are found by
doubling and halving steps on these hashes. Intervals found at several levels or with multiples of a period are one run with the
smallest period. In the end each run is compared word by word; a block in which a hash was wrong (never seen) is worked again with
comparisons of words in place of hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, buffers, in_batches, mix

#: Texts are worked in blocks of so many bytes; a longer text is a block of its own, and its words are read in pieces of so many bytes.
BLOCK = 1 << 20
#: Pairs of words that are compared at once.
PAIRS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces that end at white space."""
    low = 0
    while low < len(text):
        cut = _SPACE.search(text, low + BLOCK) if len(text) - low > BLOCK else None
        high = cut.start() if cut else len(text)
        yield text[low:high].split()  # bytes split at the space and the controls from tab to carriage return
        low = high


def interned(text: bytes, ids: dict[bytes, int], upto: int) -> np.ndarray:
    """A number for each word of a text, equal for equal words: where the word came first, counted from upto on."""
    found = [np.zeros(0, np.int64)]
    for words in pieces(text):
        found.append(np.fromiter(map(ids.setdefault, words, range(upto, upto + len(words))), np.int64, len(words)))
        upto += len(words)
    return np.concatenate(found)


class Sequence:
    """Numbers, with the common extensions of two places to the right and to the left: Z-values for any middle."""

    def __init__(self, s: np.ndarray, exact: bool = False):
        self.s, self.exact = s, exact
        if not exact:
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(s), _BASE))), dtype=np.uint64)
            self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s.astype(np.uint64)) * self.up[:-1], dtype=np.uint64)))

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, left: bool) -> np.ndarray:
        """Whether the n numbers from a on equal those from b > a on (left: those before a and before b)."""
        fits = (n <= a) if left else (n <= len(self.s) - b)
        n = np.where(fits, n, 0)
        if left:
            a, b = a - n, b - n
        return fits & ((self.total[a + n] - self.total[a]) * self.up[b - a] == self.total[b + n] - self.total[b])

    def extension(self, a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
        """How many numbers from a on equal those from b > a on, one by one (left: those before a and before b)."""
        out, active, span = np.zeros(len(a), np.int64), np.arange(len(a)), 1
        if self.exact:
            while len(active):
                step = -1 - out[active] if left else out[active]
                x, y = a[active] + step, b[active] + step
                ok = (x >= 0) & (y < len(self.s))
                active = active[ok][self.s[x[ok]] == self.s[y[ok]]]
                out[active] += 1
            return out
        failed = np.zeros(len(a), np.int64)
        while len(active):
            ok = self.same(a[active], b[active], out[active] + span, left)
            failed[active[~ok]] = span
            active = active[ok]
            out[active] += span
            span *= 2
        while span > 1:
            span //= 2
            active = np.flatnonzero(failed > span)
            out[active[self.same(a[active], b[active], out[active] + span, left)]] += span
        return out


def _pairs(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n[k] numbers from 1 on for each k: k and the number, in parts of PAIRS."""
    ends = np.cumsum(n)
    for low in range(0, int(ends[-1]) if len(n) else 0, PAIRS):
        high = min(low + PAIRS, int(ends[-1]))
        k0, k1 = np.searchsorted(ends, [low, high - 1], "right")
        each = np.minimum(ends[k0 : k1 + 1], high) - np.maximum(ends[k0 : k1 + 1] - n[k0 : k1 + 1], low)
        k = np.repeat(np.arange(k0, k1 + 1), each)
        yield first[k], np.arange(low, high) - (ends - n)[k] + 1


def crossing(q: Sequence, a: np.ndarray, p: np.ndarray, shortest: int) -> np.ndarray:
    """(start, length, p) of the stretches with period p around a and a + p, at least 2p and shortest long."""
    s, b = q.s, a + p
    near = (s[a] == s[b]) | (s[a - 1] == s[b - 1])
    a, b, p = a[near], b[near], p[near]
    if not q.exact:
        need = (np.maximum(p, shortest - p) + 1) // 2  # one side has half of what both need
        near = q.same(a, b, need, False) | q.same(a, b, need, True)
        a, b, p = a[near], b[near], p[near]
    left, right = q.extension(a, b, left=True), q.extension(a, b)
    kept = left + right >= np.maximum(p, shortest - p)
    return np.stack((a - left, left + right + p, p), axis=1)[kept]


def runs(s: np.ndarray, bounds: np.ndarray, shortest: int, exact: bool = False) -> np.ndarray:
    """(start, length, period) of all runs at least shortest long, by start, then period.

    s: numbers with one that is nowhere else before the first text and after each; bounds: start and end of each text in s.
    """
    q, found = Sequence(s, exact), [np.zeros((0, 3), np.int64)]
    lo, hi = bounds[:, 0], bounds[:, 1]
    while True:
        wide = hi - lo >= max(shortest, 2)
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        found += [crossing(q, m, p, shortest) for m, p in _pairs(mid, hi - mid)]
        found += [crossing(q, m - p, p, shortest) for m, p in _pairs(mid, mid - lo)]
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
    r = np.concatenate(found)
    r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]
    if len(r):
        r = r[np.concatenate(([True], (r[1:, :2] != r[:-1, :2]).any(axis=1)))]  # the smallest period of each interval
        r = r[np.lexsort((r[:, 2], r[:, 0]))]
    if not exact:
        for start, length, p in r.tolist():
            end = start + length
            if s[start - 1] == s[start - 1 + p] or s[end] == s[end - p] or not np.array_equal(s[start : end - p], s[start + p : end]):
                return runs(s, bounds, shortest, exact=True)
    return r


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: it is in no run after that run's first period words."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def collapsed_texts(texts: list[bytes], shortest: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs, and the kept words joined by one space, of each text."""
    ids: dict[bytes, int] = {}
    parts, at = [np.array([-1])], 1
    bounds = np.zeros((len(texts), 2), np.int64)
    for k, text in enumerate(texts):
        words = interned(text, ids, at)
        bounds[k] = at, at + len(words)
        at += len(words) + 1
        parts += [words, np.array([-2 - k])]
    found = runs(np.concatenate(parts), bounds, shortest)
    upto = np.searchsorted(found[:, 0], bounds)
    for k, text in enumerate(texts):
        n, mine = int(bounds[k, 1] - bounds[k, 0]), found[upto[k, 0] : upto[k, 1]] - [bounds[k, 0], 0, 0]
        keep, out, at = kept_words(n, mine), [], 0
        for words in pieces(text):
            some = keep[at : at + len(words)]
            out.append(b" ".join(words) if some.all() else b" ".join([words[i] for i in np.flatnonzero(some).tolist()]))
            at += len(words)
        yield n, mine, b" ".join([x for x in out if x])


def collapsed(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, text): every run of at least shortest words of each row's whole text, and what is left of it.

    runs has (start, length, period) by start, then period; starts count words from 0. A word goes if any run holds it after
    that run's first period words; text is the other words joined by one space. A null or empty text has no words, no runs and
    an empty text. Texts of any length are worked whole, in some 30 bytes a word and the distinct words. Rows with a null
    doc_id and rows that repeat one are worked like others; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            found = []
            for first, last in blocks(offsets, BLOCK):
                found += collapsed_texts([data[offsets[k] : offsets[k + 1]].tobytes() for k in range(first, last)], shortest)
            if found:
                r = np.concatenate([x[1] for x in found])
                at = np.concatenate(([0], np.cumsum([len(x[1]) for x in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(r[:, i]) for i in range(3)], names=["start", "length", "period"]))
                text = pa.array([x[2] for x in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.int64()), lists, text], names=["doc_id", "n_words", "runs", "text"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
    return in_batches(docs.select("doc_id", "text"), run, schema)
