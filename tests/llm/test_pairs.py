"""Near duplicates, components and repeated passages against plain versions."""

import hashlib
import random
import re

import pytest

from marquee.llm import minhash, substrings
from marquee.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fixture(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=70)
    texts = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            words = (rng.choice(texts) or "").split()
            for _ in range(rng.randint(0, max(1, len(words) // 15))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.5:
            words = rng.choices(vocabulary, k=rng.randint(0, 90)) + passage[rng.randint(0, 15) :] + rng.choices(vocabulary, k=rng.randint(0, 90))
        else:
            words = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 40, 60, 120, 300]))
        texts.append(rng.choice([" ", "\n", "\t ", " "]).join(words))
    texts[5], texts[6], texts[7], texts[8] = None, "", " \n ", "É É é É \xa0 x"
    return [(k * 3, t, "en", "s", 0) for k, t in enumerate(texts)]


def jaccard_components(rows, n):
    sets = {}
    for doc, text, *_ in rows:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]
        sets[doc] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rows = fixture(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, n).collect()}
    assert got == jaccard_components(rows, n)
    assert sum(1 for x in got.values() if not x[2]) > 5


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A  B\nC"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "1 AS component_id", "2 AS kept", "3 AS bucket")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 2).collect())
    assert got == [(-1, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert minhash.near_duplicates(docs.where("false"), 2).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with other texts are documents of their own: each is linked by its own text."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (5, f"{a} x"), (6, f"{b} y"), (7, b), (8, a), (2, b), (2, c), (9, c), (9, "z"), (None, c)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 1, False), (8, 1, False), (2, 1, False), (2, 2, True), (9, 2, False), (9, 9, True), (None, None, True)], key=str)
    keyed = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, keyed=True).where("doc_id = 1").collect()
    assert len({r.group for r in keyed}) == 2 == len({r.key for r in keyed})


def test_passages_of_repeated_ids(spark):
    """(1, a), (2, a), (2, b): the second loses all its words, the third none."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (2, b), (3, f"{b} {a}"), (None, a)]
    got = substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text[:2]) for r in got.collect()), key=str) == sorted([(1, 60, 0, "a0"), (2, 60, 60, ""), (2, 60, 0, "b0"), (2, 60, 0, "b0"), (3, 120, 120, ""), (None, 60, 0, "a0")], key=str)


def test_operators_in_parallel_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    rows = fixture(33)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = lambda: sorted(map(tuple, minhash.near_duplicates(docs, 2).collect()))
    gone = lambda: sorted(map(tuple, substrings.substring_dedup(docs).collect()))
    with ThreadPoolExecutor(4) as pool:
        found = [f.result() for f in [pool.submit(near), pool.submit(gone), pool.submit(near), pool.submit(gone)]]
    assert found[0] == found[2] == [(d, *x) for d, x in sorted(jaccard_components(rows, 2).items())]
    assert found[1] == found[3] and [(d, n, r) for d, n, r, _ in found[1]] == [(d, n, r) for d, (n, r, _) in sorted(removed_plainly(rows, 50).items())]


def test_scratch_tables(spark):
    from types import SimpleNamespace

    from marquee import tables

    with tables.Scratch(spark, "a") as outer:
        inner = tables.Scratch(spark, "b", outer)
        one, two = inner.cut(spark.range(3), "t"), inner.cut(spark.range(4), "t")
        inner.keep_only(two)
        assert two.count() == 4 and inner.folder.startswith(outer.folder)
        with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
            one.count()
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        two.count()
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(cluster)


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(200, 200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if x != 200}


def removed_plainly(rows, length):
    first = {}
    words = {d: WORD.findall(t or "") for d, t, *_ in rows}
    for d in sorted(words):
        for k in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][k : k + length]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < d:
                gone.update(range(k, k + length))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def longest_plainly(rows, least):
    """Words of the longest passage of each document that another one holds too; 0 below `least`."""
    words = {d: WORD.findall(t or "") for d, t, *_ in rows}
    owners, out = {}, dict.fromkeys(words, 0)
    longest = max(map(len, words.values()))
    for n in range(least, longest + 1):
        owners = {}
        for d, w in words.items():
            for k in range(len(w) - n + 1):
                owners.setdefault(tuple(w[k : k + n]), set()).add(d)
        found = {d for ds in owners.values() if len(ds) > 1 for d in ds}
        if not found:
            break
        out |= dict.fromkeys(found, n)
    return out


def test_lengths_of_repeated_passages(spark):
    rows = fixture(61)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_removed, r.longest) for r in substrings.substring_dedup(docs, 20, lengths=True).collect()}
    true = longest_plainly(rows, 20)
    assert all(20 <= n <= true[d] if n else n == 0 for d, (_, n) in got.items())
    texts = {d: " ".join(WORD.findall(t or "")) for d, t, *_ in rows}
    copies = [d for d in got if len(texts[d].split()) >= 80 and sum(texts[d] == t for t in texts.values()) > 1]
    assert copies and all(got[d][1] * 2 >= len(texts[d].split()) - 40 for d in copies)
    assert sum(n > 40 for _, n in got.values()) > 3


def test_levels():
    assert substrings.levels(50) == [25, 50] and substrings.levels(7) == [4, 7] and substrings.levels(200) == [25, 50, 100, 200] and substrings.levels(1) == [1]


@pytest.mark.parametrize("length", [50, 7, 64, 110, 1])
def test_substrings(spark, length):
    rows = fixture(length + 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.kept_digest(substrings.substring_dedup(docs, length)).collect()}
    assert got == removed_plainly(rows, length)
    assert sum(1 for x in got.values() if x[1]) > (10 if length <= 64 else 3)


def test_substrings_of_odd_tables(spark):
    text = " ".join(f"x{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text + "  end"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "0 AS first", "0 AS n", "0 AS spans")
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.substring_dedup(docs).collect()}
    assert got == {None: (60, 0, text), 1: (60, 0, text), 2: (61, 60, "end"), 3: (0, 0, None), 4: (0, 0, "")}
    assert substrings.substring_dedup(docs.where("false")).count() == 0


def test_asked_rows_are_those_of_a_semi_join(spark):
    from marquee.llm.common import asked_rows

    docs = spark.createDataFrame([(k, f"t{k}") for k in [None, -5, *range(400), 7, 7]], "doc_id long, text string")
    asked = spark.createDataFrame([(k,) for k in (-5, 7, 399, 1000)], "doc_id long")
    assert sorted(r.doc_id for r in asked_rows(docs, asked).collect()) == [-5, 7, 7, 7, 399]
    assert asked_rows(docs, asked.where("false")).count() == 0
    assert asked_rows(docs.where("false"), asked).columns == ["doc_id", "text"]
