"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules count words and repetition. The method adds one score per text and a cutoff per stratum. The score is a sum of
integer log odds over binned features, counted on one half of the labelled texts (by a hash of doc_id). The other half, the
holdout, decides: for each stratum and each cutoff on a fixed grid, k of its n good texts that pass the base would be
rejected, and the exact binomial probability of k or fewer rejections at a true rate of `risk` is the test's p value.

Multiple testing: the cutoffs of a stratum are tested from the mildest on, each at the same level, and the first that fails
ends the sequence (fixed-sequence testing), so the grid costs nothing; the level is `mistake` divided by the number of strata
(Bonferroni). Each stratum takes its last cutoff before that, or none. So with probability 1 - mistake, in no stratum are more
than `risk` of the good texts rejected. With the default risk of 5 % and four strata a cutoff needs 86 good texts in the
stratum's holdout at least; a stratum with fewer keeps all that passes the base.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import Scratch
from .common import SPACE, WORD, free_names

RISK, MISTAKE = 0.05, 0.05
#: Cutoffs lie at -GRID * STEP, ... 0, ... GRID * STEP, which spans the scores; texts below a cutoff go.
GRID, STEP = 24, 500
SMOOTH = 1.0


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more, from an array of words.

    Windows are sorted by hash and place; those equal to a neighbour are repeated; sorted by place again, each adds the
    words that the next one doesn't.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            m = F.size(s)
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < m) & (F.get(s, k + 1)["h"] == x["h"])))
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-2).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

        return F.when(n >= 4, _let(F.sort_array(windows), covered)).otherwise(0)

    return F.coalesce(_let(words, count), F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none of all; columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    w, x = free_names(docs.columns, "words", "lines")
    return (
        docs.withColumn(w, words)
        .withColumn(x, lines)
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, SPACE, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col(w)).cast("long"))
        .drop(w, x)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Features and their bins, of the counts in measured(): integer division keeps every engine's bins alike.
def bins() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    ratio = lambda a, times, most: F.least(F.expr(f"({a} * {times}) div greatest(n_words, 1)"), F.lit(most)).cast("int")
    return {
        "length": F.least(F.length(F.bin(words)), F.lit(14)).cast("int"),
        "word": ratio("word_chars", 2, 24),
        "symbols": ratio("n_symbols", 20, 30),
        "lines": ratio("n_dup_lines", 100, 10),
        "repeats": ratio("n_repeat_words", 20, 20),
    }


def _log_choose(n: Column, k: Column) -> Column:
    """ln(n over k) for n >= k >= 20, by Stirling's series."""

    def log_factorial(x: Column) -> Column:
        x = x + 1.0
        return (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)

    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Probability of at most k of n at rate p. Terms over 40 standard deviations below the mean, under 1e-300, are left out."""
    k, n = k.cast("double"), n.cast("double")
    low = F.floor(n * p - 40 * F.sqrt(n * p * (1 - p)) - 40).cast("double")
    low = F.when(low >= 20, low).otherwise(0.0)
    term = F.when(low > 0, _log_choose(n, F.greatest(low, F.lit(20.0))) + low * math.log(p) + (n - low) * math.log1p(-p)).otherwise(n * math.log1p(-p))
    steps = F.when(k > low, F.sequence((low + 1).cast("long"), F.greatest(k, low + 1).cast("long"))).otherwise(F.array().cast("array<long>"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j * (p / (1 - p)))
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(steps, F.struct(term.alias("t"), F.exp(term).alias("s")), add, lambda a: a["s"])
    return F.when(k < low, 0.0).otherwise(F.least(total, F.lit(1.0)))


def weights(train: DataFrame) -> dict[str, int]:
    """round(1000 * (ln(share of good) - ln(share of bad))) of each bin in train (.., quality): as many numbers as there are bins."""
    cells = train.select("quality", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in bins()))).alias("c"))
    counts = cells.groupBy("c.feature", "c.bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    share = lambda k: F.log((F.col(k) + SMOOTH) / (F.sum(k).over(W.partitionBy("feature")) + 2 * SMOOTH))
    rows = counts.select("feature", "bin", F.round(1000 * (share("good") - share("bad"))).cast("int").alias("w")).collect()
    return {f"{r['feature']}:{r['bin']}": r["w"] for r in rows}


def score(of: dict[str, int]) -> Column:
    """Sum of the weights of a row's bins; a bin that training didn't see weighs nothing."""
    if not of:
        return F.lit(0).cast("long")
    table = F.create_map(*(F.lit(x) for pair in sorted(of.items()) for x in pair))
    parts = (F.coalesce(F.element_at(table, F.concat(F.lit(f"{n}:"), F.col(n).cast("string"))), F.lit(0)) for n in bins())
    return sum(parts, F.lit(0)).cast("long")


def cutoffs(holdout: DataFrame, stratum: str, risk: float = RISK, mistake: float = MISTAKE, scratch: Scratch | None = None) -> DataFrame:
    """(stratum, cutoff, tested, rejected, p_value): the last cutoff before the first unsafe one, of each stratum that has one.

    holdout has score and stratum of good texts that pass the base; one row per stratum and cutoff is all that the tests see,
    whatever the number of texts. Texts with a score equal to a cutoff stay.
    """
    scratch = Scratch(holdout.sparkSession, "cutoffs", scratch)
    cell = F.least(F.greatest(F.expr(f"floor((score + {GRID * STEP}) / {STEP}) + 1"), F.lit(0)), F.lit(2 * GRID + 1)).cast("int")  # cutoffs that a score reaches
    cells = holdout.groupBy(F.col(stratum).alias("stratum"), cell.alias("cell")).count()
    per = scratch.cut(cells.groupBy("stratum").agg(F.sum("count").alias("tested"), F.collect_list(F.struct("cell", "count")).alias("cells")), "cells")
    level = mistake / max(1, per.count())
    tests = per.select("*", F.posexplode(F.array(*(F.lit(STEP * k) for k in range(-GRID, GRID + 1)))).alias("at", "cutoff"))
    rejected = F.aggregate(F.filter("cells", lambda c: c["cell"] <= F.col("at")), F.lit(0).cast("long"), lambda a, c: a + c["count"])
    tests = tests.withColumn("rejected", rejected).withColumn("p_value", binomial_tail(F.col("rejected"), F.col("tested"), risk))
    fails = F.min(F.when(F.col("p_value") > level, F.col("cutoff"))).over(W.partitionBy("stratum"))
    safe = tests.withColumn("fails", fails).where("fails is null or cutoff < fails")
    return safe.groupBy("stratum").agg(F.max(F.struct("cutoff", "tested", "rejected", "p_value")).alias("best")).select("stratum", "best.*")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, mistake: float = MISTAKE, scratch: Scratch | None = None) -> DataFrame:
    """For every row of docs (doc_id, text, stratum column): doc_id, the counts, base_failed, kept, score, cutoff.

    labels (doc_id, quality: 1 good, 0 bad): those of docs whose md5(doc_id) starts with an even digit give the weights, the others are the
    holdout. A null stratum is one of its own. kept is false if the base fails or the score is below the stratum's cutoff (a
    tie stays); a stratum without a safe cutoff keeps what passes the base. Null texts fail the base. Labels that repeat a doc_id with
    one quality count once, contradicting ones are left out; a null doc_id has no label. Rows that repeat a doc_id are judged
    each by its own text and all count with the id's label. Texts of any length are read whole: a row needs memory for its own
    words. Other columns are ignored. Empty tables work.
    """
    scratch = Scratch(docs.sparkSession, "quality", scratch)
    rows = measured(docs.select("doc_id", "text", F.coalesce(F.col(stratum).cast("string"), F.lit("(none)")).alias("stratum")))
    rows = scratch.cut(rows.withColumn("base_failed", base_failed()).withColumns(bins()).drop("text"), "features")  # small rows; texts are read once
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    labelled = rows.join(known, "doc_id")
    half = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 2
    total = score(weights(labelled.where(half == 0)))
    holdout = labelled.where((half == 1) & (F.col("quality") == 1) & ~F.col("base_failed")).withColumn("score", total)
    found = scratch.cut(cutoffs(holdout, "stratum", risk, mistake, scratch).select("stratum", "cutoff"), "cutoffs")
    out = rows.withColumn("score", total).join(found, "stratum", "left")
    verdict = ~F.col("base_failed") & F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"), "score", F.col("cutoff").cast("long").alias("cutoff"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
cov AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY r),
f AS (SELECT w.r, doc_id, stratum, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.r = cov.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  ['length:' || least(length(bin(greatest(n_words, 1))), 14), 'word:' || least(word_chars * 2 // greatest(n_words, 1), 24), 'symbols:' || least(n_symbols * 20 // greatest(n_words, 1), 30),
   'lines:' || least(n_dup_lines * 100 // greatest(n_words, 1), 10), 'repeats:' || least(n_repeat_words * 20 // greatest(n_words, 1), 20)] AS cells FROM f),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
lab AS (SELECT b.*, quality, ('0x' || substr(md5(b.doc_id::VARCHAR), 1, 1))::INT % 2 AS half FROM b JOIN known USING (doc_id)),
cnt AS (SELECT cell, split_part(cell, ':', 1) AS feature, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM (SELECT unnest(cells) AS cell, quality FROM lab WHERE half = 0) GROUP BY cell),
wt AS (SELECT cell, round(1000 * (ln((good + 1.0::DOUBLE) / (sum(good) OVER (PARTITION BY feature) + 2)) - ln((bad + 1.0::DOUBLE) / (sum(bad) OVER (PARTITION BY feature) + 2))))::BIGINT AS v FROM cnt),
sc AS (SELECT u.r, coalesce(sum(v), 0)::BIGINT AS score FROM (SELECT r, unnest(cells) AS cell FROM b) u LEFT JOIN wt USING (cell) GROUP BY u.r),
hold AS (SELECT stratum, score FROM lab JOIN sc USING (r) WHERE half = 1 AND quality = 1 AND NOT base_failed),
tests AS (SELECT s.stratum, s.tested, s.strata, 500 * k AS cutoff, (SELECT count(*) FROM hold WHERE hold.stratum = s.stratum AND score < 500 * k) AS rejected
  FROM (SELECT stratum, count(*) AS tested, count(*) OVER () AS strata FROM hold GROUP BY stratum) s, range(-24, 25) g(k)),
pv AS (SELECT *, (SELECT sum(exp(lgamma(tested + 1) - lgamma(j + 1) - lgamma(tested - j + 1) + j * ln(0.05) + (tested - j) * ln(0.95))) FROM range(0, rejected + 1) q(j)) AS p_value FROM tests),
seq AS (SELECT *, min(CASE WHEN p_value > 0.05 / strata THEN cutoff END) OVER (PARTITION BY stratum) AS fails FROM pv),
best AS (SELECT stratum, max(cutoff) AS cutoff FROM seq WHERE fails IS NULL OR cutoff < fails GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score >= cutoff, TRUE) AS kept, score, cutoff::BIGINT AS cutoff
FROM b JOIN sc USING (r) LEFT JOIN best USING (stratum)
"""
