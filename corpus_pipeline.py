"""A corpus pipeline: language ID, near duplicates, repeated passages, mixing, packing, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm import language_id, minhash, mixing, packing, substrings
from marquee.llm.common import text_key
from marquee.llm.queries import held_out
from marquee.tables import Scratch, delete, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose best language isn't so many times as probable as a guess among all languages is rejected.
OVER_CHANCE = 1.2


#: The folder of the stage that run is at; a stage that is called alone leaves its scratch tables to the shared folder.
_within: Scratch | None = None


def _scratch(spark: SparkSession, name: str) -> Scratch:
    return Scratch(spark, name, _within)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: `und` goes, and so does what no language fits; lang becomes the prediction.

    A null or empty text, or one without a letter, is `und`. Whole texts decide, of any length; ties go to the first language
    by name. Rows with a null doc_id and rows that repeat one are judged like others. Without labelled texts there is no
    network, and all rows are `und`. Further columns are left out; an empty table gives an empty result.
    """
    network = language_id.fit(docs.where(~held_out()))
    found = language_id.predicted(docs, network, keep=("text", "source", "n_chars")).withColumnRenamed("lang_pred", "lang")
    least = OVER_CHANCE / len(network.languages) if network else 1.0
    return found.where((F.col("lang") != language_id.UNKNOWN) & (F.col("score") >= least)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8): the one with the least doc_id.

    Rows that repeat a doc_id with other texts are documents of their own; of those that repeat it with one text the first by
    lang, source and n_chars stays (nulls last); rows with a null doc_id all stay. Null and empty texts are like nothing and stay. Texts of any length count whole. Further columns are left out; an
    empty table gives an empty result.
    """
    scratch = _scratch(spark, "near-duplicates")
    groups = minhash.near_duplicates(docs, scratch=scratch, keyed=True)
    rows = scratch.cut(groups.where("kept and doc_id is not null").groupBy("group", "doc_id", "key").agg(F.count("*").alias("rows")), "groups")
    one = rows.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "key", "rows")).alias("one")).select("one.*")
    kept = scratch.cut(one.unionByName(rows.where("group is null").drop("group")).withColumnRenamed("key", "_key"), "kept")
    scratch.keep_only(kept)
    docs = docs.select(*COLUMNS)
    held = docs.where("doc_id is not null").withColumn("_key", text_key()).join(kept, ["doc_id", "_key"])
    found = held.where("rows = 1").select(*COLUMNS).unionByName(docs.where("doc_id is null"))
    if not kept.where("rows > 1").isEmpty():  # else there is no second pass over the texts
        order = W.partitionBy("doc_id", "_key").orderBy(*(F.col(c).asc_nulls_last() for c in COLUMNS[1:]))
        found = found.unionByName(held.where("rows > 1").withColumn("place", F.row_number().over(order)).where("place = 1").select(*COLUMNS))
    return found


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds (50-word windows); those with nothing left go.

    A document that loses nothing keeps its text as it is, null and empty ones too. A null doc_id is neither a source nor
    changed; rows that repeat a doc_id don't remove each other, and each loses what its own text repeats. Texts of any length count whole. Further columns are left out;
    an empty table gives an empty result.
    """
    clean = substrings.substring_dedup(docs, length=50, keep=("lang", "source"), scratch=_scratch(spark, "passages"))
    words = F.col("n_words") - F.col("n_removed")
    return clean.where((F.col("n_removed") == 0) | (words > 0)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says.

    A null source is a source; a null or empty text has no words, so it counts nothing and is taken at its source's rate. Rows
    that repeat a doc_id draw alike; a null doc_id draws as the empty string does. Texts may be of any length. Further columns
    are left out; an empty table gives an empty result.
    """
    return mixing.mixed(docs.select(*COLUMNS), scratch=_scratch(spark, "mixing"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); every copy of a document has pieces of its own.

    A null or empty text is the end id alone. Texts of any length are cut into windows, none is dropped. Rows that repeat a
    doc_id and null ones are packed like others. Other columns are left out; an empty table gives an empty result.
    """
    return packing.packed(_scratch(spark, "pieces").cut(packing.pieces(docs), "pieces"))


STAGES = [
    ("language_id", identify_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashing and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again; what a stage has read and its scratch tables go once its own rows are written."""
    global _within
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with Scratch(spark, f"stage-{name}") as _within:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        _within = None
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    return docs
