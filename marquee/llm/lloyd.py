"""Centroid clustering of integer vectors: Lloyd's rounds that touch only what the round before has changed.

Every vector keeps its owner (the nearest centroid) and its squared distance, and the driver keeps the sum and the number of
the vectors of each centroid. A round knows which centroids moved. A vector whose owner stayed where it was is compared with
the centroids that moved alone; one whose owner moved is compared with all. Vectors that change hands are transfers: minus the
vector for the old owner, plus for the new one. Their sums are made before the shuffle, and k rows of them reach the driver,
which adds them to the sums and floors the means. When no centroid moves, all further rounds would change nothing.

All arithmetic is on 64-bit integers, so results don't depend on the order of rows. Rows are never shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Scratch
from .common import in_batches

#: Components of a larger magnitude are left out with their vector: 4096 squares of sums of two still fit into 63 bits.
LARGEST = 1 << 24
#: Rows whose distances are computed at once.
ROWS = 4096


def integers(vectors: DataFrame, dims: int, scale: int = 1024) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors with exactly dims components, none null, NaN or infinite.

    Null and empty vectors are left out, and so are those with a component beyond LARGEST after scaling, whose distances could
    pass 63 bits. Rows with a null vec_id and rows that repeat one stay. Other columns are ignored.
    """
    scaled = F.transform("embedding", lambda x: F.lit(scale) * x.cast("double"))
    kept = (F.size("embedding") == dims) & F.forall("_scaled", lambda x: F.coalesce(F.abs(x) <= LARGEST, F.lit(False)))  # NaN is above all numbers
    return vectors.select("vec_id", "embedding", scaled.alias("_scaled")).where(kept).select("vec_id", F.transform("_scaled", lambda x: F.floor(x).cast("int")).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:vec_id`; null ids last, equal ones by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()]


def nearest(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and squared distance after comparing with the centroids of these numbers; ties go to the smaller number."""
    for c in numbers:
        d = x - centroids[c]
        d = np.einsum("ij,ij->i", d, d)
        better = (d < distance) | ((d == distance) & (c < owner))
        owner, distance = np.where(better, c, owner), np.where(better, d, distance)
    return owner, distance


def assigned(state: DataFrame, centroids: list[list[int]], moved: list[int]) -> DataFrame:
    """state (vec_id, x, owner, distance) with the owners after the centroids numbered moved have moved, and the owner before."""
    places, moved_ = np.array(centroids, np.int64), np.array(sorted(moved), np.int32)
    far = np.iinfo(np.int64).max

    def run(batches):
        for batch in batches:
            column, before = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            x, had = column.flatten().to_numpy().reshape(len(column), -1), batch.column(3).to_numpy(zero_copy_only=False)
            owner, distance = np.empty_like(before), np.empty(len(before), np.int64)
            for low in range(0, len(before), ROWS):
                part, o, d = x[low : low + ROWS].astype(np.int64), before[low : low + ROWS].copy(), had[low : low + ROWS].copy()
                lost = np.isin(o, moved_) | (o < 0)  # the distance to their owner is out of date
                if lost.any():
                    n = len(places)
                    o[lost], d[lost] = nearest(part[lost], places, np.arange(n, dtype=np.int32), np.full(lost.sum(), n, np.int32), np.full(lost.sum(), far))
                if not lost.all():
                    o[~lost], d[~lost] = nearest(part[~lost], places, moved_, o[~lost], d[~lost])
                owner[low : low + ROWS], distance[low : low + ROWS] = o, d
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(owner), pa.array(distance), pa.array(before)], names=["vec_id", "x", "owner", "distance", "before"])

    schema = f"vec_id {dict(state.dtypes)['vec_id']}, x array<int>, owner int, distance long, before int"
    return in_batches(state.select("vec_id", "x", "owner", "distance"), run, schema)


def transfers(state: DataFrame, dims: int) -> list[tuple[int, int, list[int]]]:
    """(centroid, change of its number of vectors, change of their sum) of the vectors that changed hands: at most one row a centroid."""
    given = state.where("owner <> before").select(F.explode(F.array(F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")), F.struct(F.col("owner").alias("c"), F.lit(1).alias("sign")))).alias("t"), "x").where("t.c >= 0")
    sums = [F.sum(F.col("t.sign") * F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    return [(r[0], r[1], list(r[2:])) for r in given.groupBy("t.c").agg(F.sum("t.sign"), *sums).collect()]


def clustered(vectors: DataFrame, centroids: list[list[int]], rounds: int = 10, scratch: Scratch | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of vectors (vec_id, x of equally many integers) after so many rounds, and the final centroids.

    A round assigns every vector to the nearest centroid, ties to the smaller number, and replaces each centroid that owns
    vectors by floor(sum / number) of theirs; the others stay. Then all are assigned once more. Each round's assignments are a
    table of scratch, so lost executors cost one round at most; the one before is deleted. Rows may repeat; without a
    centroid there are no rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "lloyd")
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    dims, centroids = len(centroids[0]), [list(c) for c in centroids]
    state = vectors.select("vec_id", "x", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    sums, sizes, moved = [[0] * dims for _ in centroids], [0] * len(centroids), list(range(len(centroids)))
    for turn in range(rounds + 1):
        if not moved:
            break
        state = scratch.cut(assigned(state, centroids, moved), "round")
        scratch.keep_only(state)
        if turn == rounds:
            break
        for c, n, change in transfers(state, dims):
            sizes[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], change, strict=True)]
        moved = []
        for c, n in enumerate(sizes):
            place = [s // n for s in sums[c]] if n else centroids[c]
            if place != centroids[c]:
                centroids[c] = place
                moved.append(c)
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """clustered's rows with cluster_inertia, inertia and centroid_sha256; the table of centroids has as many rows as there are centroids."""
    spark: SparkSession = found.sparkSession
    each = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    rows = [(c, each.get(c, 0), sum(each.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
