"""Language identification by a byte convolutional network trained in numpy.

Texts are read as UTF-8 bytes in windows of fixed length that overlap by the filters' width. Filters of several widths over
learned byte vectors are max-pooled over a window, and a softmax layer gives its languages; a text's distribution is the
mean over its windows, weighted by their bytes. The network is fitted on a bounded sample of labelled texts (fit's
parameters per_language and per_text); prediction covers every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffers, in_batches

WINDOW, WIDTHS, FILTERS, DEPTH = 128, (2, 3, 4), 8, 6
#: Bound of the labelled sample: texts of each language, windows of each text, and texts of all languages (with many, each gives fewer, ten at least).
PER_LANGUAGE, PER_TEXT, SAMPLE = 700, 3, 45_000
UNKNOWN = "und"


class Network:
    """Byte vectors, filters, and the softmax layer; arrays are float32.

    Filters of all widths stand side by side in one matrix, a shorter one with zeros where the widest goes on, so that one
    product gives all responses.
    """

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.vectors = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        self.mask = np.repeat(np.arange(max(WIDTHS))[:, None] < np.repeat(WIDTHS, FILTERS), DEPTH, axis=0)
        self.filters = (rng.normal(0, 1, self.mask.shape) * self.mask / np.sqrt(self.mask.sum(axis=0))).astype(np.float32)
        self.offsets = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.weights = np.zeros((FILTERS * len(WIDTHS), len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.offsets, self.weights, self.bias]

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Of each filter at each place. windows: n x WINDOW bytes."""
        flat = self.vectors[windows].reshape(len(windows), -1)
        n, size = windows.shape[1] - max(WIDTHS) + 1, len(self.filters)
        grams = np.lib.stride_tricks.as_strided(flat, (len(windows), n, size), (flat.strides[0], DEPTH * flat.itemsize, flat.itemsize))
        return (grams.reshape(-1, size) @ self.filters).reshape(len(windows), n, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        most = self.responses(windows)
        while (n := most.shape[1]) > 1:  # halves at a time: far faster than a reduction of the middle axis
            half = (n + 1) // 2
            most = np.maximum(most[:, :half], most[:, n - half :])
        hidden = np.maximum(most[:, 0] + self.offsets, 0)
        score = hidden @ self.weights + self.bias
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        scores = self.responses(windows)
        at = scores.argmax(axis=1)
        hidden = np.maximum(np.take_along_axis(scores, at[:, None], 1)[:, 0] + self.offsets, 0)
        z = hidden @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels)
        g = (p @ self.weights.T) * (hidden > 0)
        found = windows[np.arange(len(windows))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        x = self.vectors[found].reshape(len(windows), len(self.offsets), -1)
        vectors = np.stack([np.bincount(found.ravel(), (g[:, :, None, None] * self.filters.T.reshape(1, len(self.offsets), -1, DEPTH))[..., d].ravel(), 256) for d in range(DEPTH)], axis=1)
        return [vectors.astype(np.float32), np.einsum("nf,nfd->df", g, x) * self.mask, g.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def trained(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 800, batch: int = 128, rate: float = 1.5e-2, seed: int = 5) -> Network:
    """A fixed number of Adam steps on the cross entropy, however small the sample; every language weighs alike."""
    net, rng = Network(languages), np.random.default_rng(seed)
    order = np.concatenate([rng.choice(np.flatnonzero(labels == k), max(np.bincount(labels)), replace=True) if (labels == k).sum() < max(np.bincount(labels)) else np.flatnonzero(labels == k) for k in range(len(languages))])
    first, second, step = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    while step < steps:
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            step += 1
            pick = order[at : at + batch]
            for p, g, m, v in zip(net.parameters(), net.gradients(windows[pick], labels[pick]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate / (1 + 5 * step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            if step == steps:
                break
    return net


def cut_windows(data: np.ndarray) -> np.ndarray:
    """All windows of a text: they overlap by the widest filter less one; a short last one is filled up with spaces."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.full((n - 1) * step + WINDOW, 32, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


def sample_windows(docs: DataFrame, label: str, per_language: int, per_text: int) -> Iterator[tuple[bytes, str]]:
    """Windows of about per_language texts of each label, chosen by a hash of doc_id; from each text those at hashed places."""
    counts = docs.groupBy(label).agg(F.count("*").alias("count"))
    each = min(per_language, max(10, SAMPLE // max(1, counts.count())))
    rate = F.least(F.lit(1.0), F.lit(float(each)) / F.col("count"))
    # counts has a row for each language, as the network's last layer has, so it fits wherever the network does
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.join(F.broadcast(counts), label).where(chance < rate)

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            found, langs = [], []
            for k, (doc, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if offsets[k] < offsets[k + 1]:
                    windows = cut_windows(data[offsets[k] : offsets[k + 1]])
                    for w in sorted(np.random.default_rng((doc or 0) & 0xFFFFFFFF).permutation(len(windows))[:per_text]):
                        found.append(windows[w].tobytes())
                        langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(langs, pa.string())], names=["bytes", "lang"])

    rows = in_batches(picked.select("doc_id", "text", label), run, "bytes binary, lang string").orderBy("bytes", "lang").collect()
    return [(bytes(r["bytes"]), r["lang"]) for r in rows]


def fit(docs: DataFrame, label: str = "lang", per_language: int = PER_LANGUAGE, per_text: int = PER_TEXT) -> Network | None:
    """The network for docs (doc_id, text, label); None without a labelled text.

    It learns from about per_language texts of each label, fewer with more than 64 labels (SAMPLE), per_text windows of each:
    that bound holds for any size of docs. Each text is drawn by itself, so a label with very few or only empty texts can be left
    out; null labels and texts are. Repeated rows are sampled
    together, as a hash of doc_id decides.
    """
    found = sample_windows(docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", label), label, per_language, per_text)
    if not found:
        return None
    languages = sorted({lang for _, lang in found})
    windows = np.frombuffer(b"".join(b for b, _ in found), np.uint8).reshape(-1, WINDOW)
    return trained(windows, np.array([languages.index(lang) for _, lang in found]), languages)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predicted(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = (), batch_windows: int = 64) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text): the most probable label and its probability.

    keep names further columns of docs to hand on.

    A null or empty text or one without a letter is `und` with score 0, and so is all without a network. Only the text decides;
    of languages with equal probability the first by name is taken. Texts of any length are read whole, in windows. Repeated
    rows each get a row; columns that keep doesn't name are ignored; an empty table gives an empty result.
    """
    names = network.languages if network else []

    def of_block(data: np.ndarray, offsets: np.ndarray) -> tuple[list, list]:
        parts = [cut_windows(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        counts = np.array([len(p) for p in parts])
        windows = np.concatenate(parts)
        p = np.concatenate([network.probabilities(windows[k : k + batch_windows]) for k in range(0, len(windows), batch_windows)])
        step = WINDOW - max(WIDTHS) + 1
        weight = np.full(len(windows), step, np.float64)
        last = np.cumsum(counts) - 1
        weight[last] = np.maximum(1, np.diff(offsets) - (counts - 1) * step)
        first = np.concatenate(([0], last[:-1] + 1))
        mean = np.add.reduceat(p * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
        best = mean.argmax(axis=1)
        return [names[b] for b in best], np.clip(mean[np.arange(len(best)), best], 0, 1).tolist()

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            letters = batch.column(2).to_pylist()
            langs, scores = [], []
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1)
                if network:
                    a, b = of_block(data, offsets[at : to + 1])
                else:
                    a, b = [UNKNOWN] * (to - at), [0.0] * (to - at)
                langs += a
                scores += b
                at = to
            langs = [x if ok else UNKNOWN for x, ok in zip(langs, letters, strict=True)]
            scores = [x if ok else 0.0 for x, ok in zip(scores, letters, strict=True)]
            more = [batch.column(3 + k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more], names=["doc_id", "lang_pred", "score", *held])

    held = [f"c{k}" for k in range(len(keep))]
    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, lang_pred string, score double", *(f"{h} {kinds[c]}" for c, h in zip(keep, held, strict=True))])
    given = docs.select(F.col("doc_id").cast("long"), "text", has_letter(F.col("text")).alias("letter"), *(F.col(c).alias(h) for c, h in zip(keep, held, strict=True)))
    return in_batches(given, run, schema).select("doc_id", "lang_pred", "score", *(F.col(h).alias(c) for c, h in zip(keep, held, strict=True)))
