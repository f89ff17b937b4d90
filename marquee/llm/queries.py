"""The queries op1 to op13, each an operator with production parameters over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, language_id, lloyd, minhash, mixing, packing, periodic, quality_rules, sharding, substrings, tiff, url_rules
from ..tables import Scratch
from .common import WORD, table

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language_id.fit(docs.where(~held_out()))
    return language_id.predicted(docs, network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"))
    parts = Scratch(spark, "op5").cut(parts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return packing.packed(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return sharding.sharded(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, similarity=0.8)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digest(substrings.substring_dedup(table(spark, sf_dir, "documents"), length=50, lengths=True))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.stored_texts(table(spark, sf_dir, "documents"))
    media = media.select(F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("key"), "media")
    pages = tiff.read_pages(media, "key", "media")
    pixels = F.col("pixels")
    return pages.select(
        "key.doc_id",
        "key.n_bytes",
        F.octet_length(pixels).cast("long").alias("payload_bytes"),
        F.sha2(pixels, 256).alias("payload_sha256"),
        F.crc32(F.substring(pixels, -64, 64)).alias("tail_crc32"),
        "key.media_bytes",
        "key.media_sha256",
        "feature",
        "page",
        "width",
        "height",
        "error",
    )


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document by hash, the words from one place on become a repetition of those that follow it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    sized = words.withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, g % n, 0L)")).withColumn("p", F.expr("1L + (n - a) div (3 + g % 8)"))
    planted = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return sized.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapsed(with_planted_runs(table(spark, sf_dir, "documents")), shortest=12)
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words").select(
        "doc_id",
        "n_runs",
        (-F.col("most.start")).alias("start"),
        F.col("most.length").alias("length"),
        (-F.col("most.period")).alias("period"),
        F.expr("1000 * most.length div -most.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
        "n_words",
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    back = bpe.decoded(ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256")), path, public_tokenizers.PATTERN)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = lloyd.integers(table(spark, sf_dir, "embeddings"), dims=64)
    found, centroids = lloyd.clustered(vectors, lloyd.first_centroids(vectors, 8, seed=3), rounds=10)
    return lloyd.with_inertia(found, centroids)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_html_extraction, op3_language_id, op4_mixing, op5_packing, op6_sharding, op7_minhash_dedup, op8_substring_dedup, op9_tiff, op10_url_rules, op11_periodic_runs, op12_byte_bpe, op13_delta_lloyd)
    return {f.__name__: f for f in found}


_URL = r"regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', {})"
OP10_SQL = f"""
WITH u AS (SELECT page_id, translate(coalesce({_URL.format(1)}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce({_URL.format(2)}, '') AS path FROM pages),
m AS (SELECT *, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""


_CRC = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n))"
OP6_SQL = f"""
WITH t AS MATERIALIZED (SELECT {_CRC} AS crc),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, k, length(h) // 2 AS n, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT) AS bytes FROM d),
p AS (SELECT doc_id, n + 8 AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
  ('0x' || substr(md5(k), 1, 5))::BIGINT % greatest(64, (SELECT count(*) FROM d) // {24 * sharding.SLOT_ROWS} + 1) AS part,
  ({sharding.draws_sql(24)})::INT AS shard, ({sharding.draws_sql(25)})::INT AS grown_shard FROM b, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS LAST) - 1 AS slot, grown_shard FROM p
"""


_OWNED = "a{r} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v.x) AS x, min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 8 + c) AS near FROM kept v, c{r} c GROUP BY r)"
_MEANS = """c{n} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
  SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT near % 8 AS c, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)"""
OP13_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(1024 * e::DOUBLE) <= {lloyd.LARGEST})) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h NULLS LAST, x LIMIT 8)),
{", ".join(_OWNED.format(r=r) + ", " + _MEANS.format(r=r, n=r + 1) for r in range(10))}, {_OWNED.format(r=10)}
SELECT vec_id, (near % 8)::INT AS cluster, near // 8 AS distance, sum(near // 8) OVER (PARTITION BY near % 8)::BIGINT AS cluster_inertia, sum(near // 8) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a10 JOIN c10 c ON c.c = near % 8
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": OP6_SQL, "op1_quality_rules": quality_rules.ORACLE_SQL, "op4_mixing": mixing.ORACLE_SQL, "op10_url_rules": OP10_SQL, "op13_delta_lloyd": OP13_SQL}
