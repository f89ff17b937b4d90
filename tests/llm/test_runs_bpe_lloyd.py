"""Periodic runs against all pairs, byte-level BPE against a library and round trips, Lloyd's rounds against a plain loop."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marquee.llm import bpe, lloyd, periodic, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def plain_runs(words, shortest):
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(shortest, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def wordlists(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        k = rng.choice([1, 2, 3, 6, 60])
        words = [f"w{rng.randrange(k)}" for _ in range(rng.randint(0, 130))]
        if words and rng.random() < 0.5:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 3))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        yield words


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_against_all_pairs(shortest):
    lists = list(wordlists(shortest, 150))
    for low in range(0, len(lists), 7):
        some = lists[low : low + 7]
        for words, (n, found, text) in zip(some, periodic.collapsed_texts([" \n".join(w).encode() for w in some], shortest), strict=True):
            want = plain_runs(words, shortest)
            assert n == len(words) and list(map(tuple, found.tolist())) == want
            assert text.decode() == plain_collapse(words, want)


def test_runs_without_hashes_and_of_known_words():
    fibonacci, thue = ["a", "b"], "a"
    for _ in range(11):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for _ in range(12):  # differences of these words are zero under many running hashes
        thue += thue.translate(str.maketrans("ab", "ba"))
    for text in (fibonacci[-1], thue[:4000], "a" * 3000, "ab" * 700 + "c"):
        s = np.array([-1, *map(ord, text), -2])
        bounds = np.array([[1, len(text) + 1]])
        fast, slow = periodic.runs(s, bounds, 2), periodic.runs(s, bounds, 2, exact=True)
        assert np.array_equal(fast, slow)
        if len(text) < 1500:
            assert [(a - 1, n, p) for a, n, p in slow.tolist()] == plain_runs(text, 2)


def test_words_of_a_long_text_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 50)
    monkeypatch.setattr(periodic, "PAIRS", 64)
    words = ["x" * 70, *("one two three".split() * 9), "y", *("é ü".split() * 20)]
    ((n, found, text),) = periodic.collapsed_texts(["\t".join(words).encode()], 12)
    want = plain_runs(words, 12)
    assert n == len(words) and list(map(tuple, found.tolist())) == want and text.decode() == plain_collapse(words, want)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def periodic_row(doc_id, text):
    words = planted(doc_id, text)
    found = plain_runs(words, 12)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(plain_collapse(words, found)))


PERIODIC = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 60))) for _ in range(120)] + [None, "", " \n ", "a " * 40, "É \x0b" * 30, "x\xa0y " * 20]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (3, "q " * 13), (None, "r " * 15), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 AS runs", "'x' AS words", "1 AS n").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).select(*PERIODIC).collect()
    assert sorted(map(tuple, got), key=str) == sorted((periodic_row(*r) for r in rows), key=str)
    assert queries.op11_periodic_runs(spark.newSession(), SF).count() > 0
    empty = periodic.collapsed(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "runs", "text"]


@needs_data
def test_periodic_query_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 9000]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF).select(*PERIODIC).collect()}
    assert len(got) == len(docs) and len(short) > 0.8 * len(docs)
    assert all(got[r.doc_id] == periodic_row(r.doc_id, r.text) for r in short)


@pytest.fixture(scope="module")
def library():
    engine = bpe.engine(VOCABULARY, public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=engine.ranks, special_tokens={})


def odd_texts():
    rng = random.Random(7)
    letters = lambda some, k: "".join(rng.choices(some, k=k))
    yield from ["", "a", " ", "\n", "it's we'll I'd 'S", "x <|endoftext|> y", "\x00\x01 \x7f", "naïve café Ωμέγα", "日本語のテキストです。", "👍🏽👨‍👩‍👧", "1234567890" * 40]
    yield from [" " * 900 + "x", " " * 900, "\n \n" * 300, "th" * 800, "ab" * 600, "a" * 1001, "=-" * 500, "-" * 999, "ÃÂ" * 300, "แ" * 500 + "ก" * 200]
    yield from [letters("abcdefghijklmnopqrstuvwxyz", 129), letters("etaoinshr", 1500), letters("ab", 2000), letters("the", 2000), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400))]
    yield from [" ".join(letters("etaoinshrdlu", rng.randint(1, 20)) for _ in range(60)) for _ in range(20)]


def test_ids_of_odd_texts(library):
    engine = bpe.engine(VOCABULARY, public_tokenizers.PATTERN)
    texts = list(odd_texts())
    ids, counts = engine.encoded(texts)
    ends = counts.cumsum()
    for text, last, n in zip(texts, ends, counts, strict=True):
        assert ids[last - n : last].tolist() == library.encode_ordinary(text), text[:40]
    assert engine.decoded(ids, counts) == [t.encode() for t in texts]


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 30)
    monkeypatch.setattr(bpe, "SLICE_IDS", 7)
    engine = bpe.Engine(VOCABULARY, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(6):
        text = " ".join("".join(rng.choices("aeioust", k=5)) for _ in range(25))
        ids, counts = engine.encoded([text, ""])
        assert ids.tolist() == library.encode_ordinary(text) and counts.tolist() == [len(ids), 0]
        assert engine.decoded(ids, counts) == [text.encode(), b""]


def bpe_row(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_query_on_odd_rows(spark, library, tmp_path):
    rows = [*enumerate([*odd_texts(), None]), (4, "again"), (4, "other"), (None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 AS ids", "'x' AS bytes").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_byte_bpe(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((bpe_row(library, *r) for r in rows), key=str)
    none = bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY, public_tokenizers.PATTERN)
    assert bpe.decoded(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_decoding_of_odd_lists(spark):
    rows = [(1, [31373, 995], "k"), (2, [], None), (3, None, "k"), (1, [198], "z")]
    got = bpe.decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>, `a b` string"), VOCABULARY, public_tokenizers.PATTERN).collect()
    assert [(r.doc_id, bytes(r.bytes), r["a b"]) for r in got] == [(1, b"hello world", "k"), (2, b"", None), (3, b"", "k"), (1, b"\n", "z")]
    for bad in ([50256], [1, None]):
        with pytest.raises(Exception, match="vocabulary|null"):
            bpe.decoded(spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>"), VOCABULARY, public_tokenizers.PATTERN).collect()


@needs_data
def test_bpe_query_on_the_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op12_byte_bpe(spark, SF).collect())) == sorted(bpe_row(library, *r) for r in docs)


def plain_lloyd(rows, dims, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    places = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(places))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(near(v)[1], []).append(v)
        places = [[sum(x) // len(mine[c]) for x in zip(*mine[c], strict=True)] if c in mine else p for c, p in enumerate(places)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, c, d in last:
        inertia[c] = inertia.get(c, 0) + d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, places[c])).encode()).hexdigest()) for i, c, d in last]


VECTORS = "vec_id long, embedding array<double>"


@pytest.mark.parametrize(("seed", "n", "rounds"), [(1, 300, 10), (2, 40, 3), (3, 5, 10), (4, 9, 1), (5, 120, 0)])
def test_rounds_against_a_plain_loop(spark, seed, n, rounds):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) + rng.randint(-3, 3) / 1024 for _ in range(4)]) for i in range(n)]
    rows += [(0, rows[0][1]), (1, rows[2][1]), (None, rows[3][1]), (None, [9.0] * 4), (90, None), (91, []), (92, [1.0] * 3), (93, [1.0] * 5), (94, [1.0, None, 1.0, 1.0]), (95, [float("nan")] * 4), (96, [1.0, float("-inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], VECTORS + ", owner int, _scaled string")
    vectors = lloyd.integers(df, dims=4)
    found, centroids = lloyd.clustered(vectors, lloyd.first_centroids(vectors, 8, seed=3), rounds=rounds)
    assert sorted(map(tuple, lloyd.with_inertia(found, centroids).collect()), key=str) == sorted(plain_lloyd(rows, 4, 8, rounds), key=str)


def test_nothing_to_cluster(spark):
    vectors = lloyd.integers(spark.createDataFrame([(1, [1.0]), (2, [1e9] * 4)], VECTORS), dims=4)
    found, centroids = lloyd.clustered(vectors, lloyd.first_centroids(vectors, 8, seed=3))
    assert centroids == [] and lloyd.with_inertia(found, centroids).count() == 0


def test_only_vectors_that_change_hands_are_summed(spark, monkeypatch):
    sizes, before = [], lloyd.transfers
    monkeypatch.setattr(lloyd, "transfers", lambda state, dims: sizes.append(state.where("owner <> before").count()) or before(state, dims))
    rng = random.Random(6)
    vectors = lloyd.integers(spark.createDataFrame([(i, [rng.gauss(i % 3, 0.2) for _ in range(4)]) for i in range(400)], VECTORS), dims=4)
    lloyd.clustered(vectors, lloyd.first_centroids(vectors, 3, seed=3))
    assert sizes[0] == 400 and all(n < 400 for n in sizes[1:]) and len(sizes) <= 10
