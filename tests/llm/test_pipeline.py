"""The pipeline's stages against plain versions, each on its own input."""

import hashlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as pipeline

from .test_pairs import fixture, jaccard_components, removed_plainly

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicate_stage(spark):
    rows = fixture(21)
    docs = spark.createDataFrame([*rows, rows[9], (None, "a b", None, None, None)], COLUMNS)
    got = pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = {d for d, (_, _, kept) in jaccard_components(rows, 5).items() if kept}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted([*map(str, want), "None"])


def test_repeated_passages_stage(spark):
    rows = fixture(22)
    docs = spark.createDataFrame(rows, COLUMNS)
    got = {r.doc_id: r for r in pipeline.drop_repeated_passages(spark, docs, "").collect()}
    texts = {d: t for d, t, *_ in rows}
    for d, (n, gone, digest) in removed_plainly(rows, 50).items():
        if gone and gone == n:
            assert d not in got
        elif gone:
            assert hashlib.sha256(got[d].text.encode()).hexdigest() == digest and got[d].n_chars == len(got[d].text)
        else:
            assert got[d].text == texts[d] and (got[d].lang, got[d].source) == ("en", "s")


def odd_documents(spark):
    words = {"en": "the cat and the dog went to the old house with them", "fr": "le chat et le chien sont dans la maison de leurs amis"}
    rows = [(k, f"{words[lang]} {k} " * 12, lang, f"s{k % 3}", 7) for k, lang in enumerate(["en", "fr"] * 30)]
    odd = [(None, words["en"] * 9, None, None, None), (3, "one more row of the same id and it is long", "en", None, 1), (3, "one more row of the same id and it is long", "en", None, 1), (90, None, "en", "s", None), (91, "", "fr", "s", 0), (92, "12 34 --", "fr", "s", 0), (93, words["fr"] * 3000, None, "s0", 0)]
    return spark.createDataFrame(rows + odd, COLUMNS).selectExpr("*", "1 AS part", "2 AS score", "3 AS copies")


def test_language_stage(spark):
    """All rows with letters whose language the network tells are kept, with it as lang; held against the network's own answer."""
    docs = odd_documents(spark)
    got = pipeline.identify_languages(spark, docs, "")
    network = pipeline.language_id.fit(docs.where(~pipeline.held_out()))
    want = pipeline.language_id.predicted(docs, network, keep=("text",)).where("lang_pred <> 'und' and score >= 0.6").collect()
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=str) == sorted(((r.doc_id, r.text, r.lang_pred) for r in want), key=str)
    assert {90, 91, 92}.isdisjoint({r.doc_id for r in want}) and len(want) >= 60


def test_mixing_stage(spark):
    from collections import Counter
    from math import floor

    docs = odd_documents(spark)
    rows = docs.collect()
    size = lambda r: len((r.text or "").split())
    total = Counter()
    for r in rows:
        total[r.source] += size(r)
    target = {r.source: r.target for r in pipeline.mixing.targets(spark.createDataFrame(list(total.items()), "source string, source_size long")).collect()}
    want = Counter()
    for r in rows:
        rate = target[r.source] / total[r.source] if total[r.source] else 0.0
        unit = (int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        want[(r.doc_id, r.text, r.source)] += floor(rate) + (unit < rate - floor(rate))
    got = pipeline.mix_sources(spark, docs, "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +want


def test_packing_stage(spark):
    import public_tokenizers
    from collections import Counter
    from tokenizers import Tokenizer

    docs = odd_documents(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, want = Counter(), Counter()
    for r in pipeline.pack_sequences(spark, docs, "").collect():
        got[(r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens)] += 1
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 2048):
            want[(r.doc_id, k, len(ids[k : k + 2048]), ids[k : k + 2048].tobytes(), len(ids))] += 1
    assert got == want


def test_one_row_of_a_repeated_id_stays(spark):
    text = "some words of a text that is here twice or more"
    docs = spark.createDataFrame([(1, text, "en", "b", 1), (1, text, "en", "a", 2), (1, text, "de", None, 3), (2, text + " and", "en", "c", 4)], COLUMNS).selectExpr("*", "1 AS order", "2 AS rows")
    assert [(r.doc_id, r.lang, r.n_chars) for r in pipeline.drop_near_duplicates(spark, docs, "").collect() if r.doc_id == 1] == [(1, "de", 3)]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = pipeline.identify_languages(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.where("length(text) > 20").count()
    out = pipeline.run(spark, SF).collect()
    by = {}
    for r in out:
        assert len(np.frombuffer(r.ids, "<u4")) == r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        out = stage(spark, empty, "")
        assert out.count() == 0
        if stage is not pipeline.STAGES[-1][1]:
            assert out.columns == empty.columns
