"""Packing by minimum bin slack over a histogram of lengths.

Documents become token ids; a document is cut into full windows, which are sequences as they are, and a remainder.
All that planning needs is how many remainders have each length: at most 2047 numbers, whatever the corpus. For each
sequence a subset-sum over the remaining multiset, as bitsets, finds the filling closest to capacity around the longest
remaining length, and backtracking through the bitsets gives its counts; the filling is used as often as the counts allow.
Remainders are then numbered within their length, and the number decides sequence and place.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import Scratch
from .common import free_names, in_batches

CAPACITY, END = 2048, 1
#: Remainders of a length that one task numbers, about.
PART_ROWS = 1 << 18


def tokenizer_file(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def special_strings(name: str) -> list[str]:
    """Strings of the special tokens of the tokenizer file `name`.json."""
    return [t.content for t in tokenizer_file(name).get_added_tokens_decoder().values()]


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, by the tokenizer file `name`.json and the same vocabulary's ranks.

    Texts that hold one of its special strings are left to the tokenizer itself, and so are those on which the ranks' pattern
    runs out of its stack, as it does in very long runs of white space. The tokenizer is loaded when the first such text comes.
    """

    def __init__(self, name: str, special: list[str] | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self.name, self.special = name, special_strings(name) if special is None else special
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        return tokenizer_file(self.name)

    def ids(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            try:
                return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): every document's ids, then end, cut into windows of capacity.

    ids are little-endian unsigned 32-bit numbers: those of `tokenizers` for the whole text without special tokens, taken from
    the same vocabulary by the faster library where no special token's string or very long white space occurs (a test holds both
    equal over whole tables). A null or empty text is the end id alone; texts of any length are cut, none is dropped. Rows with a
    null doc_id and rows that repeat one get pieces of their own; other columns are ignored; an empty table gives an empty result.
    """

    special = special_strings(tokenizer)

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer, special))
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, start, part, total = [], [], [], []
                docs_, texts = batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist()
                for doc, text in zip(docs_, texts, strict=True):
                    whole = encoder.ids(text or "") + last
                    for k in range(0, len(whole), 4 * capacity):
                        ids.append(doc)
                        start.append(k // 4)
                        part.append(whole[k : k + 4 * capacity])
                        total.append(len(whole) // 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in part], pa.int64()), pa.array(part, pa.binary()), pa.array(total, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(length: number in a sequence, number of such sequences) until counts is used up; lengths are below capacity.

    A filling is used until one of its lengths runs short, which at least halves that length's count: there are at most
    capacity * log2(rows) fillings, each of at most sqrt(2 * capacity) different lengths.
    """
    left, out, mask = {k: v for k, v in counts.items() if v > 0}, [], (1 << (capacity + 1)) - 1
    while left:
        longest = max(left)
        room = capacity - longest
        steps, reach = [], 1
        for length in sorted((k for k in left if k <= room), reverse=True):
            many, size = min(left[length] - (length == longest), room // length), 1
            while many > 0:  # counts as powers of two
                size = min(size, many)
                steps.append((length, size, reach))
                reach |= reach << (length * size) & mask
                many, size = many - size, 2 * size
            if reach >> room & 1:
                break
        best = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
        used = {longest: 1}
        for length, size, before in reversed(steps):
            if not before >> best & 1:
                used[length] = used.get(length, 0) + size
                best -= length * size
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (first number, first sequence, number in a sequence, first offset), by first number; the number of sequences."""
    out, seen, sequence = {}, dict.fromkeys(counts, 0), 0
    for used, times in fillings(counts, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            out.setdefault(length, []).append((seen[length], sequence, n, offset))
            seen[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}, sequence


def packed(parts: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """parts (doc_id, start, length, ...) with sequence_id and offset. parts is read several times: give a written table.

    Pieces of capacity get the sequences after those of the plan. Numbering runs by hash parts of a length, whose sizes are
    summed up before, so that no task holds a length; it moves whole rows, so
    that payloads are better left out and joined or kept apart. Columns sequence_id and offset are replaced, all others stay,
    whatever their names. An empty table gives an empty result. Rows that repeat doc_id and start are told apart by a hash of
    their other columns; rows that tie there too are alike, and either may come first. A null doc_id is numbered like any other.
    """
    scratch = Scratch(parts.sparkSession, "packing", scratch)
    names = [c for c in parts.columns if c.lower() not in ("sequence_id", "offset")]
    plain = [c for c in names if c not in ("doc_id", "start", "length") and not dict(parts.dtypes)[c].startswith(("map", "variant"))]
    sizes = parts.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in sizes.where(F.col("length") <= capacity).collect()}  # capacity rows at most
    full = counts.pop(capacity, 0)
    lengths, base = plan(counts, capacity)
    hashed = max(64, max([full, *counts.values()], default=0) // part_rows + 1)
    at, tie, number, first, of, p, spot = free_names([*names, "sequence_id", "offset"], "part", "tie", "number", "before", "of_length", "of_part", "place")
    dealt = parts.select(*names).withColumn(at, F.pmod(F.xxhash64("doc_id", "start"), F.lit(hashed))).withColumn(tie, F.xxhash64(*plain) if plain else F.lit(0))
    before = dealt.groupBy(F.col("length").alias(of), F.col(at).alias(p)).agg(F.count("*").alias("n"))
    before = scratch.cut(before.withColumn(first, F.coalesce(F.sum("n").over(W.partitionBy(of).orderBy(p).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n"), "before")
    within = F.row_number().over(W.partitionBy("length", at).orderBy(F.col("doc_id").asc_nulls_last(), "start", tie))
    numbered = dealt.withColumn(number, within).join(before, (F.col("length") == F.col(of)) & (F.col(at) == F.col(p)))
    numbered = numbered.withColumn(number, (F.col(number) - 1 + F.col(first)).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, number):
        import pandas as pd

        length, number = length.to_numpy(), number.to_numpy()
        sequence, offset = number + base, np.zeros(len(number), np.int64)
        for k in np.unique(length):
            if k in lengths:
                rows, steps = np.flatnonzero(length == k), lengths[k]
                row = steps[np.searchsorted(steps[:, 0], number[rows], "right") - 1]
                past = number[rows] - row[:, 0]
                sequence[rows] = row[:, 1] + past // row[:, 2]
                offset[rows] = row[:, 3] + past % row[:, 2] * k
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return numbered.withColumn(spot, place("length", number)).select(*names, F.col(f"{spot}.sequence_id").alias("sequence_id"), F.col(f"{spot}.offset").alias("offset"))
