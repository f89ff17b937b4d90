"""Byte-level BPE: token ids of whole texts by the ranks of a public vocabulary, and the bytes of token ids.

Each Arrow batch of a partition is worked by queries of an in-memory DuckDB in the task. A text is cut into words by the
pattern; each word that a task has not met yet is a row for each of its bytes (word, position, token), and a recursive query
joins neighbouring rows with the merge table and contracts each word's pair of least rank, the leftmost of equal ones, until
no row finds a pair. Decoding joins the rows of a text's ids with the vocabulary and aggregates their bytes in order.

A merge gives the token whose bytes are those of the pair, and its rank is that token's id, so the merge table holds every cut
of a token into two tokens. A word that is a token itself stays whole.

Words of more than SHORT bytes (runs of white space, unbroken scripts) would take a round for each merge. No token is longer
than the longest of the vocabulary, so a pair whose rank is least within that many bytes on both sides is contracted now: what
happens further off can't reach its bytes before. Neighbouring pairs of one rank, as in a run of spaces, are contracted every
second one at once, if none of them would make a pair of lesser rank; otherwise the leftmost alone.
"""

from __future__ import annotations

import base64

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Bytes of a word that the plain recursion works; positions must fit into eight bits.
SHORT = 128
#: Words whose ids a worker remembers, some 200 bytes each; beyond, it starts anew.
REMEMBERED = 400_000
#: Texts are worked in blocks of so many characters, ids in slices of so many; one long text or word is a block of its own.
BLOCK_CHARS, SLICE_IDS = 1 << 20, 1 << 19

SHORT_WORDS = """
WITH RECURSIVE step(word, pos, nxt, id, nid, round) AS (
  SELECT word, pos, nxt, id, nid, 0 FROM bytes
  UNION ALL
  SELECT s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.nxt2 ELSE s.nxt END, CASE WHEN s.pos = b.pos THEN b.made ELSE s.id END,
    CASE WHEN s.pos = b.pos THEN b.nid2 WHEN s.nxt = b.pos THEN b.made ELSE s.nid END, s.round + 1
  FROM step s JOIN (
    SELECT h.word, h.pos, h.nxt, h.made, r.nxt AS nxt2, r.nid AS nid2 FROM (
      SELECT word, (min(k) & 255)::INT AS pos, (min(k) >> 8)::INT AS made, arg_min(nxt, k) AS nxt
      FROM (SELECT s.word, s.nxt, m.made * 256 + s.pos AS k FROM step s JOIN merges m ON s.id = m.a AND s.nid = m.b) GROUP BY word) h
    JOIN step r ON r.word = h.word AND r.pos = h.nxt) b ON s.word = b.word
  WHERE s.pos <> b.nxt)
SELECT s.word, list(s.id ORDER BY s.pos) AS ids FROM step s JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) GROUP BY s.word ORDER BY s.word
"""

LONG_WORDS = """
WITH RECURSIVE step(word, pos, id, round) AS (
  SELECT word, pos, id, 0 FROM bytes
  UNION ALL
  SELECT word, pos, new, round FROM (
    SELECT word, pos, round + 1 AS round, CASE WHEN hit THEN made ELSE id END AS new, coalesce(lag(hit) OVER w, false) AS gone, bool_or(hit) OVER (PARTITION BY word) AS goes_on
    FROM (
      SELECT *, made IS NOT NULL AND CASE WHEN low & 1 = 1 THEN
          bool_and(made = low >> 1 AND low & 1 = 1) OVER (PARTITION BY word, made, place - nth) AND row_number() OVER (PARTITION BY word, made, place - nth ORDER BY pos) % 2 = 1
        ELSE made = low >> 1 AND pos = first END AS hit
      FROM (
        SELECT *, row_number() OVER (PARTITION BY word, made ORDER BY pos) AS nth,
          min(k) OVER near AS low, min(made::BIGINT * 4294967296 + pos) OVER near & 4294967295 AS first
        FROM (
          SELECT p.*, m.made, m.made::BIGINT * 2 + CASE WHEN l.made < m.made OR r.made < m.made OR t.made < m.made THEN 0 ELSE 1 END AS k
          FROM (SELECT *, lead(id) OVER w AS nid, lead(id, 2) OVER w AS after, lag(id) OVER w AS before, row_number() OVER w AS place FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)) p
          LEFT JOIN merges m ON p.id = m.a AND p.nid = m.b
          LEFT JOIN merges l ON l.a = p.before AND l.b = m.made
          LEFT JOIN merges r ON r.a = m.made AND r.b = p.after
          LEFT JOIN merges t ON t.a = m.made AND t.b = m.made)
        WINDOW near AS (PARTITION BY word ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)))
    WINDOW w AS (PARTITION BY word ORDER BY pos))
  WHERE goes_on AND NOT gone)
SELECT s.word, list(s.id ORDER BY s.pos) AS ids FROM step s JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) USING (word, round) GROUP BY s.word ORDER BY s.word
"""

DECODED = "SELECT part, list(bytes ORDER BY pos) AS bytes FROM given LEFT JOIN vocabulary USING (id) GROUP BY part ORDER BY part"


class _Numbers(dict):
    """The number of each word, in the order of their first calls."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Engine:
    """Tables of one vocabulary in an in-memory DuckDB, and the ids of the words met so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern, self.ranks, self.reach = regex.compile(pattern), ranks, max(map(len, ranks))
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "temp_directory": ""})  # nothing goes to the task's disk
        cuts = [(ranks[t[:k]], ranks[t[k:]], n) for t, n in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._table("merges", a=[c[0] for c in cuts], b=[c[1] for c in cuts], made=[c[2] for c in cuts])
        self._table("vocabulary", id=list(ranks.values()), bytes=pa.array(list(ranks), pa.binary()))
        self.forget()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v, pa.int32()) if isinstance(v, list) else v for k, v in columns.items()}))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _asked(self, name: str, table: pa.Table, query: str) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def forget(self) -> None:
        self.numbers, self.ids, self.starts = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merged(self, words: list[bytes], query: str) -> list[np.ndarray]:
        """Ids of words, each of two bytes at least, by the recursive query."""
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        pos = (np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        ids, last = self.byte[raw], np.concatenate((word[1:] != word[:-1], [True]))
        nxt, nid = np.where(last, np.int32(-1), pos + np.int32(1)), np.where(last, np.int32(-1), np.roll(ids, -1))
        out = self._asked("bytes", pa.table({"word": word, "pos": pos, "nxt": nxt, "id": ids, "nid": nid}), query)["ids"].combine_chunks()
        at, values = out.offsets.to_numpy(), out.values.to_numpy()
        return [values[at[k] : at[k + 1]] for k in range(len(words))]

    def _learn(self, words: list[bytes]) -> None:
        """Add the ids of new words, in the order of their numbers."""
        found = [np.array([self.ranks[w]], np.int32) if w in self.ranks else None for w in words]
        short = [k for k, w in enumerate(words) if found[k] is None and len(w) <= SHORT]
        if short:
            for k, ids in zip(short, self._merged([words[k] for k in short], SHORT_WORDS), strict=True):
                found[k] = ids
        for k, w in enumerate(words):
            if found[k] is None:
                found[k] = self._merged([w], LONG_WORDS.format(reach=self.reach))[0]
        self.ids = np.concatenate([self.ids, *found])
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum([len(x) for x in found])))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each text's ids."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        known, each = len(self.numbers), []
        for t in texts:
            words = self.pattern.findall(t)
            each.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        if len(self.numbers) > known:
            self._learn([w.encode() for w in list(self.numbers)[known:]])
        size = np.diff(self.starts)
        counts = np.array([size[w].sum() for w in each], np.int64)
        words = np.concatenate(each)
        n = size[words]
        at = np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[at], counts

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text, from the ids of all and their number for each. An id that the vocabulary lacks is an error."""
        owner, parts = np.repeat(np.arange(len(counts)), counts), [[] for _ in counts]
        for low in range(0, len(ids), SLICE_IDS):
            some = owner[low : low + SLICE_IDS]
            given = pa.table({"part": some, "pos": np.arange(len(some), dtype=np.int32), "id": ids[low : low + SLICE_IDS]})
            got = self._asked("given", given, DECODED)
            lists = got["bytes"].combine_chunks()
            tokens = lists.values.cast(pa.large_binary())
            if tokens.null_count:
                raise ValueError("an id is not in the vocabulary")
            ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :][lists.offsets.to_numpy()]
            for part, first, last in zip(got["part"].to_pylist(), ends[:-1], ends[1:], strict=True):
                parts[part].append(memoryview(tokens.buffers()[2])[first:last])
        return [b"".join(p) for p in parts]


_engines: dict[tuple[str, str], Engine] = {}


def engine(path: str, pattern: str) -> Engine:
    """The engine of a worker process; its tables are made once."""
    if (path, pattern) not in _engines:
        _engines[path, pattern] = Engine(path, pattern)
    return _engines[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text.

    A null or empty text has no ids. Texts and words of any length are encoded whole. No token is special: what looks like one
    is ordinary text. Rows with a null doc_id and rows that repeat one are encoded like others; columns other than doc_id and
    text are ignored; an empty table gives an empty result. path must be readable on every executor.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts, first = [], [], 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= BLOCK_CHARS):
                    size += len(texts[last])
                    last += 1
                some, each = engine(path, pattern).encoded(texts[first:last])
                ids.append(some)
                counts.append(each)
                first = last
            if ids:
                offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return in_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes, further columns of rows): the bytes of every row's ids, as encoded gives them.

    A null or empty list gives no bytes; a null among the ids, or an id that the vocabulary lacks, is an error. Rows are
    decoded one by one, whatever their doc_id; a column bytes is replaced. An empty table gives an empty result.
    """
    more = [c for c in rows.columns if c.lower() not in ("doc_id", "ids", "bytes")]
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            given = pa.ListArray.from_arrays(column.offsets, column.values) if column.null_count else column
            counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
            ids = column.flatten()
            if ids.null_count:
                raise ValueError("a null is among the ids")
            found = engine(path, pattern).decoded(ids.to_numpy(), counts) if len(given) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], names=["doc_id", "bytes", *more])

    schema = ", ".join([f"doc_id {kinds['doc_id']}, bytes binary", *(f"`{c}` {kinds[c]}" for c in more)])
    return in_batches(rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids"), *(F.col(f"`{c}`") for c in more)), run, schema)
