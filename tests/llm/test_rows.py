"""Operators on single rows and small tables against plain versions, round trips and SQL."""

import hashlib
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from marquee.llm import html_extract, language_id, mixing, packing, quality_rules, queries, sharding, tiff, url_rules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert plain(got.select(*names).toPandas().astype(object).where(lambda d: d.notna(), None).values.tolist()) == plain(want.select(*names).df().astype(object).where(lambda d: d.notna(), None).values.tolist())


def test_repeated_words_and_odd_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdef", k=rng.randint(0, 40))) for _ in range(40)] + [None, "", "a b c", "a b c d", "a a a a", "x\n\nx\n x\nx"]
    got = quality_rules.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        w = (texts[r.doc_id] or "").split()
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if x.split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(cover), len(lines) - len(set(lines)))


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10), (2, 40), (10, 300), (30, 1000)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(quality_rules.F.col("k"), quality_rules.F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(sum(comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1)), rel=1e-9)
    big = spark.createDataFrame([(19_700, 1_000_000)], "k long, n long").select(quality_rules.binomial_tail(quality_rules.F.col("k"), quality_rules.F.col("n"), 0.02)).first()[0]
    assert big == pytest.approx(0.01605, abs=5e-4)  # normal approximation


def test_cutoffs_by_fixed_sequence(spark):
    """Stratum a has a cutoff before its first unsafe one, b has too few texts, c is safe at every cutoff."""
    from math import comb

    rng = random.Random(12)
    scores = {"a": [rng.randint(900, 5000) for _ in range(280)] + [-3000] * 5 + [-800] * 20, "b": [4000] * 60, "c": [20_000] * 200}
    rows = [(k, s) for k, many in scores.items() for s in many]
    got = {r.stratum: r for r in quality_rules.cutoffs(spark.createDataFrame(rows, "stratum string, score long"), "stratum").collect()}
    tail = lambda k, n: sum(comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1))
    want = {}
    for name, many in scores.items():
        for cutoff in range(-12_000, 12_001, 500):
            k = sum(s < cutoff for s in many)
            if tail(k, len(many)) > 0.05 / 3:
                break
            want[name] = (cutoff, len(many), k)
    assert {k: (r.cutoff, r.tested, r.rejected) for k, r in got.items()} == want
    assert set(want) == {"a", "c"} and want["a"][0] == -1000 and want["c"][0] == 12_000
    for r in got.values():
        assert r.p_value == pytest.approx(tail(r.rejected, r.tested), rel=1e-9)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_cutoffs_reject_rows_of_the_table(spark):
    got = queries.op1_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.cutoff is not None for r in got) > 100
    assert sum(not r.base_failed and not r.kept for r in got) > 10


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 60, None, None, 0), (None, None, "en", "s", 0), (2, "", "en", "s", 0)], DOCS).withColumn("score", quality_rules.F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert [(r.doc_id, r.base_failed, r.kept) for r in quality_rules.judged(docs, labels).collect()].count((1, True, False)) == 1
    assert quality_rules.judged(docs.where("false"), labels.where("false")).count() == 0


def test_html_blocks_and_references():
    page = "<html><head><title>T</title></head><body><nav><a href=x>Menu</a></nav><article><h1>One &amp; two</h1><p>First  line<br>goes\n on.<p>Next &lt;b&gt; &#233; 3 < 4<ul><li>a one.<li>b two.</ul></article><form><label>Name</label></form><div class='comments'><p>Nice article, thanks!</p></div><footer>&copy; x</footer><script>var a='<p>no</p>'</script></body></html>"
    assert [t for _, t, _ in html_extract.leaf_blocks(page)] == ["Menu", "One & two", "First line goes on.", "Next <b> é 3 < 4", "a one.", "b two.", "Name", "Nice article, thanks!", "© x"]
    assert html_extract.main_text(page, html_extract.default_model()) == "One & two\nFirst line goes on.\nNext <b> é 3 < 4\na one.\nb two."


def test_html_of_long_attributes():
    long = "A1+/" * 25_000
    page = f"<nav class='menu' data-state='{{&quot;{long}&quot;: \"> <p>\"}}'><a href=x>Menu</a></nav><article><p>Before <img src=\"data:image/png;base64,{long}\" alt='a > b'>after.</p></article>"
    blocks = html_extract.leaf_blocks(page)
    assert [t for _, t, _ in blocks] == ["Menu", "Before after."]
    assert "hint=menu" in blocks[0][0].found
    assert [t for _, t, _ in html_extract.leaf_blocks(f"<p don't>One.</p><p title=\"{'x' * 9000}>Two.</p><p>Three <img src='data:{long}")] == ["One.", "Two.", "Three"]
    for part in ("<a b='>' ", '<a b="', "<a b=", "<a ", "<a b = '\"' "):
        began = time.process_time()
        html_extract.leaf_blocks(part * 200_000)
        assert time.process_time() - began < 5


def test_html_of_deep_pages():
    for page in ("<div>" * 100_000 + "x" + "</div>" * 100_000, "<span>" * 100_000 + "<div>x</div>" * 20_000, "<p><button>" + "<span>" * 50_000 + "<div>x</div></b>" * 20_000, "<ul><li>" * 50_000 + "x"):
        began = time.process_time()
        html_extract.features(html_extract.leaf_blocks(page))
        assert time.process_time() - began < 5


def test_html_keeps_formulas_and_fallbacks():
    page = "<article><h1>A title here</h1><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is one more than x.</p><p>A film: <object data=f.swf>The film shows a cat.</object> It ends.</p></article>"
    assert html_extract.main_text(page, html_extract.default_model()) == "A title here\nThe sum x+1 is one more than x.\nA film: The film shows a cat. It ends."


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_html_of_the_whole_table(spark):
    """Every page's text against the blocks of its article, taken by the standard library's parser."""
    from html.parser import HTMLParser

    away = {"nav", "header", "footer", "aside", "form", "script", "style"}

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.out, self.text = [], [], ""

        def border(self):
            if self.text.strip():
                self.out.append(" ".join(self.text.split()))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in html_extract.BLOCK:
                self.border()
            if tag not in html_extract.VOID:
                self.open.append(tag)
            elif tag in ("br", "img"):
                self.text += " "

        def handle_endtag(self, tag):
            if tag in html_extract.BLOCK:
                self.border()
            while tag in self.open and self.open.pop() != tag:
                pass

        def handle_data(self, data):
            if "article" in self.open and not away & set(self.open):
                self.text += data

    for r in html_extract.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        parser = Article()
        parser.feed(r.html)
        parser.border()
        assert r.text == "\n".join(parser.out) and r.n_chars == len(r.text)


def test_html_on_held_out_pages():
    model, right, all_ = html_extract.default_model(), 0, 0
    for html, labels in html_extract.labelled_pages(120, seed=991):
        found = html_extract.decoded(html_extract.features(html_extract.leaf_blocks(html)), model)
        right, all_ = right + sum(a == b for a, b in zip(found, labels, strict=True)), all_ + len(labels)
    assert right / all_ > 0.98


def test_viterbi_against_all_labellings():
    from itertools import product

    rng = random.Random(1)
    model = ({f: (rng.gauss(0, 1), rng.gauss(0, 1)) for f in "abcdef"}, ((0.4, -0.8), (-0.2, 0.7)))
    for _ in range(30):
        blocks = [rng.sample("abcdef", 2) for _ in range(rng.randint(1, 7))]
        score = lambda y, b=blocks: sum(model[0][f][k] for x, k in zip(b, y, strict=True) for f in x) + sum(model[1][i][j] for i, j in zip(y, y[1:], strict=False))
        assert score(html_extract.decoded(blocks, model)) == pytest.approx(max(map(score, product((0, 1), repeat=len(blocks)))))


def test_html_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p>"), (None, "u", "<article><p>Some text that is here.</p>")], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = rows_of(html_extract.extracted(pages))
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (2, "u", "", 0), (None, "u", "Some text that is here.", 23)], key=str)
    assert html_extract.extracted(pages.where("false")).count() == 0


def test_language_network_gradients():
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(97, 110, (6, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net = language_id.Network(["a", "b", "c"])
    net.weights += rng.normal(0, 0.5, net.weights.shape).astype(np.float32)
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(6), labels]).mean()
    for p, g in zip(net.parameters(), net.gradients(windows, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        assert (up - loss()) / 2e-2 == pytest.approx(float(g[at]), rel=0.1, abs=1e-3)
        p[at] = old


def test_language_network_against_a_plain_convolution(spark):
    """Filters of each width, their maxima over a window and the softmax, byte by byte; a text's distribution is the mean by bytes."""
    rng = np.random.default_rng(4)
    net = language_id.Network(["a", "b", "c"])
    net.weights += rng.normal(0, 0.5, net.weights.shape).astype(np.float32)
    net.offsets += rng.normal(0, 0.5, net.offsets.shape).astype(np.float32)

    def window(w):
        hidden = []
        for k in range(net.filters.shape[1]):
            width = language_id.WIDTHS[k // language_id.FILTERS]
            f = net.filters[:, k].reshape(-1, language_id.DEPTH)[:width]
            hidden.append(max(0.0, max(sum(float(net.vectors[w[p + j]] @ f[j]) for j in range(width)) for p in range(len(w) - max(language_id.WIDTHS) + 1)) + float(net.offsets[k])))
        z = np.array(hidden) @ net.weights + net.bias
        p = np.exp(z - z.max())
        return p / p.sum()

    texts = ["short", "one two three " * 9, "longer text é " * 30]
    got = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    step = language_id.WINDOW - max(language_id.WIDTHS) + 1
    for k, t in enumerate(texts):
        raw = t.encode()
        starts = range(0, max(1, len(raw) - max(language_id.WIDTHS) + 1), step)
        weights = [step] * (len(starts) - 1) + [max(1, len(raw) - step * (len(starts) - 1))]
        p = sum(w * window(raw[s : s + language_id.WINDOW].ljust(language_id.WINDOW)) for s, w in zip(starts, weights, strict=True)) / sum(weights)
        assert got[k].lang_pred == "abc"[p.argmax()] and got[k].score == pytest.approx(p.max(), rel=1e-4)


def test_no_label_is_left_out(spark):
    docs = spark.createDataFrame([(k, f"word{k % 90} " * 20, f"l{k % 90:02}", "s", 0) for k in range(900)], DOCS)
    assert {lang for _, lang in language_id.sample_windows(docs, "lang", 700, 1)} == {f"l{k:02}" for k in range(90)}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_language_held_out_accuracy(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out and lang is not null")
    n = got.count()
    assert got.where("lang_pred = lang").count() / n > 0.97
    for r in got.limit(50).collect():
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2


def test_language_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "123 456", "en", "s", 0), (3, "the cat and the dog", "en", "s", 0), (4, "le chat et le chien", "fr", "s", 0), (5, "x", None, "s", 0)], DOCS).selectExpr("*", "1 AS score", "2 AS letter")
    net = language_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(docs, net).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] in ("en", "fr") and 0 <= got[5][1] <= 1
    assert language_id.fit(docs.where("false")) is None
    assert {r.lang_pred for r in language_id.predicted(docs, None).collect()} == {"und"}


def test_windows_cover_all_bytes():
    for n in (0, 1, 127, 128, 129, 253, 254, 1000):
        data = (np.arange(n) % 200 + 33).astype(np.uint8)
        found = language_id.cut_windows(data)
        step = language_id.WINDOW - 3
        flat = np.concatenate([found[0], *(w[3:] for w in found[1:])])
        assert np.array_equal(flat[:n], data) and len(found) <= max(1, -(-n // step))


def test_targets_against_a_loop(spark):
    rng = random.Random(8)
    for trial in range(4):
        sizes = {rng.choice([None, "a"]) if k == 0 else f"s{k}": rng.choice([0, 1, 10, 500, 90_000]) for k in range(rng.randint(1, 9))}
        names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
        target, free, left = {}, set(names), sum(sizes.values())
        while free:
            share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
            over = {k for k in free if share[k] >= 3 * sizes[k]}
            if not over:
                target |= share
                break
            worst = min(over, key=lambda k: sizes[k] / weight[k])
            target[worst] = 3 * sizes[worst]
            left -= target[worst]
            free.remove(worst)
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(target), trial


def test_mix_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", None, 0), (None, None, "en", "s", 0), (2, "", "en", "t", 0), (2, "", "en", "t", 0)], DOCS).withColumn("size", mixing.F.lit("x"))
    got = mixing.with_copies(docs).collect()
    assert len(got) == 4 and all(0 <= r.copies <= 3 for r in got)
    assert [r.doc_id for r in mixing.mixed(docs).collect()] == [1] and mixing.mixed(docs).columns == docs.columns
    assert mixing.mixed(docs.where("false")).count() == 0


CLASHES = ("part", "before", "tie", "of_shard", "of_part", "of_length", "number", "place", "of_source", "mixed_source", "row", "copy", "region", "rack", "REGION", "n", "words")


def clashing(df):
    return df.select("*", *(mixing.F.lit(f"held {c}").alias(c) for c in CLASHES if c not in ("region",)))


def test_columns_of_any_name_stay(spark):
    docs = clashing(spark.createDataFrame([(k, f"a b c {k}", "en", f"s{k % 2}", 0) for k in range(50)], DOCS))
    names = [c for c in CLASHES if c != "region"]
    parts = clashing(spark.range(50).selectExpr("id AS doc_id", "0L AS start", "5 + id AS length"))
    for got in (sharding.sharded(docs), mixing.with_copies(docs), mixing.mixed(docs), packing.packed(parts)):
        rows = got.collect()
        assert len(rows) >= 40 and all(r[c] == f"held {c}" for r in rows for c in names)


def test_slots_of_rows_that_tie(spark):
    docs = spark.createDataFrame([(7, f"t{k}") for k in range(40)], "doc_id long, text string")
    first = {r.text: r.slot for r in sharding.sharded(docs).collect()}
    assert first == {r.text: r.slot for r in sharding.sharded(docs.repartition(7)).collect()} and sorted(first.values()) == list(range(40))
    parts = docs.selectExpr("doc_id", "0L AS start", "100L AS length", "text")
    first = {r.text: (r.sequence_id, r.offset) for r in packing.packed(parts).collect()}
    assert first == {r.text: (r.sequence_id, r.offset) for r in packing.packed(parts.repartition(5)).collect()} and len(set(first.values())) == 40


def test_shards(spark):
    docs = spark.createDataFrame([(k % 1990, f"t{k % 7}", "en", "s", 0) for k in range(2000)] + [(None, None, None, None, None)], DOCS).withColumn("part", sharding.F.lit(1))
    got = sharding.sharded(docs).collect()
    assert len(got) == 2001 and {r.shard for r in got} == set(range(24))
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert 20 < len(moved) < 160 and {r.grown_shard for r in moved} == {24}
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.sharded(docs.where("false")).count() == 0


def test_weights_move_rows_only_where_they_change(spark):
    ids = spark.range(3000).withColumn("key", sharding.F.col("id").cast("string"))
    before, after = sharding.tree(24), sharding.tree(24)
    region, racks = after[1]
    after[1] = (region, [(racks[0][0], [(s, 2.0 if k == 0 else w) for k, (s, w) in enumerate(racks[0][1])]), *racks[1:]])
    df = sharding.with_shard(sharding.with_shard(ids, sharding.F.col("key"), before, "a"), sharding.F.col("key"), after, "b")
    for r in df.where("a <> b").collect():
        assert r.b >= 12, "rows move only into the region that gained weight"


def test_fillings_are_tight():
    rng = random.Random(5)
    counts = Counter(rng.randint(1, 2047) for _ in range(5000))
    plan = packing.fillings(dict(counts))
    used = Counter()
    for filling, times in plan:
        assert sum(k * n for k, n in filling.items()) <= 2048
        for k, n in filling.items():
            used[k] += n * times
    assert used == counts
    sequences, tokens = sum(t for _, t in plan), sum(k * n for k, n in counts.items())
    assert sequences <= -(-tokens // 2048) * 1.01 + 1
    assert sum(k * n for k, n in packing.fillings({3: 2, 5: 1, 7: 1}, 10)[0][0].items()) == 10


def test_fillings_against_all_subsets():
    """A sequence's filling around the longest length has the least slack that any multiset of the others allows."""
    from itertools import product

    rng = random.Random(15)
    for _ in range(60):
        capacity = rng.randint(10, 40)
        counts = {k: rng.randint(1, 3) for k in rng.sample(range(1, capacity), rng.randint(1, 5))}
        left = dict(counts)
        for used, times in packing.fillings(dict(counts), capacity):
            for _ in range(times):
                longest = max(k for k, n in left.items() if n)
                others = {k: n - (k == longest) for k, n in left.items()}
                sums = (sum(k * n for k, n in zip(others, pick, strict=True)) for pick in product(*(range(n + 1) for n in others.values())))
                best = max(s for s in sums if s + longest <= capacity) + longest
                assert used.get(longest) and sum(k * n for k, n in used.items()) == best
                for k, n in used.items():
                    left[k] -= n
                if times > 1:
                    break  # repeated uses are checked once: later ones see a smaller multiset
            if times > 1:
                for k, n in used.items():
                    left[k] -= n * (times - 1)
        assert not any(left.values())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_op5_over_the_whole_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op5_packing(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for d, t in texts.items()}
    seen, at = Counter(), Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        seen[r.doc_id] += r.length
    assert seen == Counter({d: len(x) for d, x in ids.items()}) and max(at.values()) <= 2048
    assert len(at) <= -(-sum(at.values()) // 2048) * 1.02 + 1


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "cat\n", "Été", "x1y", "  ", "don't", "\t", "日本", "1234"], k=rng.choice([0, 3, 30, 900, 4000]))) for _ in range(60)] + [None, "", "a <|endoftext|> b", "\x1c x\x85 y\u3000z  "]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "q")], "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS part")
    parts = packing.pieces(docs).cache()
    got = packing.packed(parts).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in enumerate(texts):
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(r.doc_tokens == sum(x.length for x in mine) for r in mine)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(parts.where("false")).count() == 0


@pytest.mark.parametrize("text", [" " * 1_200_000, "\n" * 1_200_000 + "x", "a" * 1_200_000, "a \u3000\x85\xa0 \n\n b" * 1000, "<|endoftext|> x"])
def test_ids_of_odd_texts_are_the_tokenizers(text):
    encoder = packing.Encoder("byte_bpe_50k")
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.whole.encode(text, add_special_tokens=False).ids


def test_packing_deals_numbers_in_parts(spark):
    parts = spark.range(3000).selectExpr("id AS doc_id", "0L AS start", "if(id % 3 = 0, 700L, 5 + id % 40) AS length")
    got = packing.packed(parts, part_rows=50).collect()
    cells = Counter((r.sequence_id, r.offset) for r in got)
    assert max(cells.values()) == 1 and len(got) == 3000


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    rng = random.Random(compression)
    for n in (1, 3, 200):
        pixels = bytes(rng.choice([0, 0, 0, 7, rng.randrange(256)]) for _ in range(64 * n))
        (page,) = tiff.pages(tiff.write_page(pixels, 64, compression, predictor, strip_rows=7))
        assert page["pixels"] == pixels and page["error"] is None and (page["width"], page["height"]) == (64, n)
    data = bytes(rng.randrange(4) for _ in range(40_000))
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_tiff_tiles_bits_and_pages():
    import struct

    def ifd(order, fields, following):
        body = struct.pack(order + "H", len(fields))
        for tag, kind, values in fields:
            body += struct.pack(order + "HHI", tag, kind, len(values)) + struct.pack(f"{order}{len(values)}{tiff.TYPES[kind][1]}", *values).ljust(4, b"\0")
        return body + struct.pack(order + "I", following)

    tile = bytes(range(16 * 16))
    tile = tile * 3  # 16 x 16 x RGB
    fields = [(256, 3, [10]), (257, 3, [9]), (258, 3, [8]), (259, 3, [1]), (277, 3, [3]), (322, 3, [16]), (323, 3, [16]), (324, 4, [200]), (325, 4, [len(tile)])]
    bits = bytes([0b10110000, 0b01000000])
    second = [(256, 3, [3]), (257, 3, [2]), (258, 3, [1]), (259, 3, [1]), (273, 4, [190]), (278, 3, [2]), (279, 4, [2])]
    first_at, second_at = 8, 1000
    data = bytearray(1200)
    data[:8] = b"MM\0*" + struct.pack(">I", first_at)
    one, two = ifd(">", fields, second_at), ifd(">", second, first_at)
    data[8 : 8 + len(one)] = one
    data[190:192] = bits
    data[200 : 200 + len(tile)] = tile
    data[1000 : 1000 + len(two)] = two
    a, b = tiff.pages(bytes(data))
    image = np.frombuffer(tile, np.uint8).reshape(16, 16, 3)[:9, :10]
    assert a["pixels"] == image.tobytes() and a["samples"] == 3
    assert list(b["pixels"]) == [1, 0, 1, 0, 1, 0] and b["page"] == 1
    broken = bytearray(data)
    broken[200:] = b""
    assert [p["error"] is not None for p in tiff.pages(bytes(broken))][0]
    assert [p["error"] for p in tiff.pages(b"nothing")] == ["not a TIFF file"]


def test_tiff_of_malformed_files(spark):
    import struct

    def page(fields, body=b""):
        out = b"II*\0" + struct.pack("<IH", 8, len(fields))
        for tag, kind, value in fields:
            out += struct.pack("<HHI", tag, kind, 1) + struct.pack(f"<{tiff.TYPES[kind][1]}", value).ljust(4, b"\0")
        return out + struct.pack("<I", 0) + body

    def plain(**more):
        fields = {256: (4, 4), 257: (4, 4), 258: (3, 8), 259: (3, 8), 273: (4, 0), 277: (3, 1), 278: (4, 4), 279: (4, 0)}
        fields |= {int(k[1:]): v for k, v in more.items()}
        at = 10 + 12 * len(fields) + 4
        bomb = zlib.compress(bytes(50_000_000))
        fields |= {273: (4, at), 279: (4, len(bomb))}
        return page([(t, *v) for t, v in sorted(fields.items())], bomb)

    files = [plain(t258=(4, 0xFFFFFFFF)), plain(t277=(4, 0xFFFFFFFF)), plain(t259=(4, 0xFFFFFFF0)), plain(t256=(4, 0xFFFFFFFF), t257=(4, 0xFFFFFFFF)), plain(t256=(9, -4)), plain()]
    rows = {r.k: r for r in tiff.read_pages(spark.createDataFrame(list(enumerate(files)), "k int, c binary"), "k", "c").collect()}
    assert all(rows[k].error and rows[k].pixels is None for k in range(5))
    assert rows[5].error is None and bytes(rows[5].pixels) == bytes(16)
    assert len(tiff.inflate(zlib.compress(bytes(50_000_000)), 100)) == 100 and len(tiff.unpack_bits(b"\x81\0" * 10_000, 1000)) < 1200
    assert len(tiff.lzw_decode(tiff.lzw_encode(bytes(500_000)), 1000)) < 3000


def test_tiff_feature_against_a_loop():
    rng = random.Random(3)
    for height, width, samples in ((1, 64, 1), (9, 64, 1), (40, 17, 3), (64, 64, 1), (3, 2, 1)):
        image = np.array([rng.randrange(256) for _ in range(height * width * samples)], np.uint8).reshape(height, width, samples)
        cut = lambda n: [(k * n // 8, max((k + 1) * n // 8, k * n // 8 + 1)) for k in range(8)]
        cells = [sum(float(image[y, x].mean()) for y in range(a, b) for x in range(c, d)) / ((b - a) * (d - c)) for a, b in cut(height) for c, d in cut(width)]
        mean = sum(cells) / 64
        if min(abs(c - mean) for c in cells) > 1e-9:
            bits = "".join("1" if c > mean else "0" for c in cells)
            assert tiff.feature(image) == f"{int(bits, 2):016x}"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_op9_media_and_features(spark):
    for r in queries.op9_tiff(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        raw = (r.text or "").encode()
        stored = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        media = tiff.write_page(stored, 64)
        (page,) = tiff.pages(media)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and page["pixels"] == stored
        assert r.feature == tiff.feature(np.frombuffer(stored, np.uint8).reshape(-1, 64, 1))


def test_tiff_of_texts(spark):
    texts = [None, "", "a", "é" * 64, "x" * 64, "y" * 65, "long " * 9000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a")], "doc_id long, text string").selectExpr("*", "1 AS media", "1 AS page")
    media = tiff.stored_texts(docs)
    got = {r.doc_id: r for r in tiff.read_pages(media, "doc_id", "media").collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert bytes(got[k].pixels) == raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\0\xff\xff\xff\xff")], "k int, c binary")
    assert all(r.error and r.pixels is None for r in tiff.read_pages(odd, "k", "c").collect())
    assert tiff.read_pages(odd.where("false"), "k", "c").count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_op9_digests(spark):
    for r in queries.op9_tiff(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect():
        raw = (r.text or "").encode()
        stored = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))


def test_url_rules_against_a_loop(spark):
    rng = random.Random(6)
    labels = ["a", "b", "net", "org", "x-y"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    rules = list({(h, p): (h, p, rng.choice(["block", "allow"])) for h, p in [(host(), rng.choice(["/", "/en/", "/e", "/en/1", ""])) for _ in range(40)]}.values())
    urls = [(k, rng.choice(["http://", "HTTPS://", "//", ""]) + rng.choice([host(), host().upper()]) + rng.choice(["", "/", "/en/1?x=/en/", "/en/12#a", "?q", "/e://b"])) for k in range(400)] + [(400, None), (400, ""), (None, "http://net/"), (401, "http://")]
    got = rows_of(url_rules.judged(spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS key"), spark.createDataFrame(rules, "host string, path string, verdict string")))
    want = []
    for k, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([len(rest)] + [rest.index(c) for c in "/?#" if c in rest])
        h, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and path.startswith(r[1])]
        longest = max((len(r[0] + r[1]) for r in fits), default=0)
        best = [r for r in fits if len(r[0] + r[1]) == longest]
        best = sorted(best, key=lambda r: (r[2] != "block", r[0] + r[1]))[:1]
        want.append((k, h, path, best[0][0] + best[0][1] if best else None, best[0][2] if best else "allow"))
    assert got == sorted(want, key=str)
    odd = spark.createDataFrame([("net", None, "block"), (None, "/", "block"), ("org", "/", None), ("net", None, "block")], "host string, path string, verdict string")
    assert {r.page_id for r in url_rules.judged(spark.createDataFrame([(1, "x://a.net/q"), (2, "x://a.org/"), (3, "x://net" + "/y" * 50_000)], "page_id long, url string"), odd).collect() if r.verdict == "block"} == {1, 3}
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_rules.judged(spark.createDataFrame(urls, "page_id long, url string"), none).collect()} == {"allow"}
    assert url_rules.judged(spark.createDataFrame([], "page_id long, url string"), none).count() == 0


def test_rows_of_a_hot_id_are_dealt(spark):
    """A third of all rows have one id or none: no part of a shard holds them together, and slots have no gaps."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"t{k % 97}") for k in range(3000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), slot_rows=50)
    found = got.collect()
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert len(found) == 3000 and len({r.shard for r in found if r.doc_id == 7}) == 1 == len({r.shard for r in found if r.doc_id is None})
    plain = {(r.doc_id, r.text): r.shard for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(plain[r.doc_id, r.text] == r.shard for r in found)
    windows = []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "row_number" in x]
    assert windows and all("sub" in x for x in windows)


@pytest.mark.parametrize("opening", ["<!", "</", "<?", "<", "<a ", "<!--", "&", "<p a='"])
def test_pages_of_one_opening_take_linear_time(opening):
    began = time.process_time()
    html_extract.leaf_blocks("<p>text</p>" + opening * (1_000_000 // len(opening)))
    assert time.process_time() - began < 10
