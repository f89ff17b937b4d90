"""Scratch tables in the shared folder: written Parquet that cuts a plan, owned by the call that wrote it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary folder serves a local master; another master is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _local[app]


class Scratch:
    """A folder of its own for the tables of one call; other calls of the session never see it.

    keep_only() deletes the tables that no result reads any more, close() all of them. A result that is returned lazily reads
    what is left: whoever gives an operator the Scratch closes it once the result is written. Without a given one the tables
    that the result reads stay in the shared folder, as checkpoints do. `within` puts the folder into the caller's.
    """

    def __init__(self, spark: SparkSession, name: str = "scratch", within: Scratch | None = None):
        self.spark, self.folder = spark, f"{within.folder if within else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame | None] = {}
        self._made = 0

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again: the plan is cut, and lost executors cost nothing."""
        path = f"{self.folder}/{name}-{self._made}"
        self._made += 1  # a write that fails leaves its path behind
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables[path] = out
        return out

    def keep_only(self, *kept: DataFrame) -> None:
        """Delete all tables but those given."""
        for path, table in self._tables.items():
            if table is not None and not any(table is k for k in kept):
                delete(self.spark, path)
                self._tables[path] = None

    def close(self) -> None:
        self._tables.clear()
        delete(self.spark, self.folder)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: for tables that grow with the input.

    Spark guesses sizes from the files below. Parquet packs ids and repeated titles many times over, and rows that Python or
    explode() makes are taken for as many as came in, so that what looks like 10 MB can be more than the driver holds.
    """
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
