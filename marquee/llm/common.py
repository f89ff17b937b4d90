"""What the operators of this subpackage share: tables, free column names, and word hashes of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is the space and the five controls from tab to carriage return; words are what lies between.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that are hashed at once; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 18
#: Bytes of an Arrow batch, about; a longer row makes a batch of its own.
BATCH_BYTES = 2 << 20
#: Bits of the mask of asked_rows.
MASK = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES, unless the session sets another bound: rows alone don't bound a batch of texts.

    Spark reads the bound when the query runs, so it stays set in a session that had none.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not df.sparkSession.conf.get(bound, None):
        df.sparkSession.conf.set(bound, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def free_names(columns: list[str], *names: str) -> list[str]:
    """Column names like those given that columns doesn't have, in any case of letters: helpers beside columns of any name."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def asked_rows(docs: DataFrame, asked: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of docs (doc_id, ...) whose doc_id, and columns more, are in asked (each once; a written table, as it is read twice).

    The join with asked decides. Before it, a mask of MASK bits of hashed ids keeps most other rows, with their texts, out
    of the shuffle. The mask is broadcast: it has MASK / 64 rows of two numbers at most, 2 MB, whatever asked holds; where
    asked outgrows it, it lets more rows through and the join still gives the same rows.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MASK))
    cell, one = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {MASK}) % 64 as int))")
    mask = asked.select(cell.alias("_cell"), one.alias("_one")).groupBy("_cell").agg(F.bit_or("_one").alias("_bits"))
    held = docs.withColumn("_at", cell).withColumn("_one", one)
    held = held.join(F.broadcast(mask), (F.col("_at") == F.col("_cell")) & (F.col("_bits").bitwiseAND(F.col("_one")) != 0))
    return held.drop("_at", "_one", "_cell", "_bits").join(asked, ["doc_id", *more])


def text_key(text: Column | str = "text") -> Column:
    """A number that tells the texts of rows with one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def n_words(text: Column) -> Column:
    """Number of words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_unit(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of a string: any engine can repeat it."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


# ---- word hashes -------------------------------------------------------------------------------------------------

_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; base is odd."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        have = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (base, inverse))
        if size <= 1 << 22:
            _powers[int(base)] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of strings; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about limit bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words start and end, and the number of words before each document (one more at the end)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, from running sums of a polynomial over the bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK_BYTES, "right")))
        part = data[low : ends[j - 1]]
        up, down = powers(_BASE, len(part) + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = _GRAM + np.uint64(2 * salt)
    up, down = powers(base, len(words) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    return mix((total[n:] - total[:-n]) * down[:m] + np.uint64(n))


def hashed_documents(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """Number in the batch and word hashes of each document, whole texts; lower folds A-Z."""
    data, offsets = buffers(column)
    for first, last in blocks(offsets):
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        starts, ends, upto = word_spans(part, offsets[first : last + 1] - offsets[first])
        words = word_hashes(part, starts, ends)
        for k in range(last - first):
            yield first + k, words[upto[k] : upto[k + 1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x
