"""Integer k-means by block-norm screening (after the block vectors of Bottesch, Buehler and Kaechele, 2016).

Every vector is cut into segments. Of each segment two numbers are kept, worked out once: its part along the
segment's diagonal and the norm of what is left. For two vectors x and c the Cauchy-Schwarz inequality bounds every
segment's product by these, so

    |x - c|^2  >=  sum over segments of (diagonal_x - diagonal_c)^2 + (rest_x - rest_c)^2,

which is the squared distance of the two compressed vectors. A round takes the centroid whose bound is least, works out
its exact integer distance, and gives an exact distance only to those centroids whose bound does not exceed it.

Vectors are never shuffled. A task answers with one row per cluster and component, the sums of what it has read;
Spark adds them up, and the driver holds k centroids. The tables that rounds read again are in the shared folder.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.staging import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1024
#: Components from here on, as integers, could overflow a long's squared distance.
MOST = 1 << 27
#: Vectors of a step inside a task.
STEP = 8_192


def whole(v: Column) -> Column:
    """Whether an array holds no null and no component that is not finite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(v: Column) -> Column:
    """floor(1024 x) of each component; one that a long's distances cannot hold is an error, not a wrong number."""
    small = lambda x: F.abs(x) < MOST // SCALE
    wide = F.raise_error(F.lit(f"a component of {MOST // SCALE} or more has no integer here")).cast("long")
    return F.transform(v, lambda x: F.when(small(x), F.floor(x * SCALE)).otherwise(wide))


def matrix(column, dim: int, kind=np.int64) -> np.ndarray:
    """An Arrow list column of lists of ``dim`` numbers as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def compressed(q: np.ndarray, segments: int) -> np.ndarray:
    """For each row the segments' parts along their diagonals, then the norms of the rest."""
    cut = q.astype(float).reshape(len(q), segments, -1)
    along = cut.sum(2) / np.sqrt(cut.shape[2])
    rest = np.sqrt(np.maximum((cut * cut).sum(2) - along * along, 0))
    return np.concatenate([along, rest], 1)


def nearest(q: np.ndarray, short: np.ndarray, centroids: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, exact squared distance and number of exact distances worked out, for each row; ties to the smaller."""
    c = compressed(centroids, segments)
    size, c_size = (short * short).sum(1), (c * c).sum(1)
    reach = size[:, None] + c_size
    bound = reach - 2 * (short @ c.T) - 1e-9 * reach - 1  # rounding never lifts a bound above the truth
    cluster = bound.argmin(1)
    best = ((q - centroids[cluster]) ** 2).sum(1)
    first, exact = cluster.copy(), np.ones(len(q), np.int32)
    for k in range(len(centroids)):
        at = np.flatnonzero((bound[:, k] <= best) & (first != k))
        d = ((q[at] - centroids[k]) ** 2).sum(1)
        exact[at] += 1
        won = at[(d < best[at]) | ((d == best[at]) & (k < cluster[at]))]
        best[won] = d[(d < best[at]) | ((d == best[at]) & (k < cluster[at]))]
        cluster[won] = k
    return cluster.astype(np.int32), best, exact


def _compress(dim: int, segments: int):
    def run(batches):
        for b in batches:
            short = compressed(matrix(b.column("q"), dim), segments)
            lists = pa.ListArray.from_arrays(np.arange(0, short.size + 1, short.shape[1], dtype=np.int32), pa.array(short.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), lists], ["vec_id", "q", "short"])

    return run


def _steps(batches, centroids: np.ndarray, segments: int):
    dim = centroids.shape[1]
    for b in batches:
        for lo in range(0, b.num_rows, STEP):
            part = b.slice(lo, STEP)
            q = matrix(part.column("q"), dim)
            yield part, q, nearest(q, matrix(part.column("short"), 2 * segments, float), centroids, segments)


def _sums(centroids: np.ndarray, segments: int):
    """A row per cluster and component: the sum over all rows of the task; component -1 has the number of rows."""

    def run(batches):
        k, dim = centroids.shape
        total = np.zeros((k, dim + 1), np.int64)
        for _, q, (cluster, _, _) in _steps(batches, centroids, segments):
            for c in range(k):
                rows = q[cluster == c]
                total[c, 0] += len(rows)
                total[c, 1:] += rows.sum(0)
        c, pos = np.nonzero(np.repeat(total[:, :1], dim + 1, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((pos - 1).astype(np.int32)), pa.array(total[c, pos])], ["cluster", "pos", "s"])

    return run


def _assign(centroids: np.ndarray, segments: int):
    def run(batches):
        for part, _, (cluster, best, exact) in _steps(batches, centroids, segments):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster), pa.array(best), pa.array(exact)], ["vec_id", "cluster", "distance", "n_exact"])

    return run


def centroid_clustering(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, segments: int = 8, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact of every kept vector.

    Kept are vectors of exactly ``dim`` components, none null or not finite; others, null vectors too, have no row. The
    first centroids are the k kept vectors with the smallest sha256 of ``salt:id``, all of them if there are fewer.
    Ties go to the smaller cluster, so of equal centroids only the first wins vectors; an empty cluster stays. Rows
    with a null id take part and are the last to be a centroid; a repeated row counts once more, and of one id's rows
    the smaller vector is taken first. n_exact is the number of exact distances of the last assignment. A component of
    131,072 or more is an error. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = rows.where((F.size("v") == dim) & whole(F.col("v"))).select("vec_id", integers(F.col("v")).alias("q"))
    kept = scratch.store(kept.mapInArrow(_compress(dim, segments), "vec_id long, q array<long>, short array<double>"), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("q", rank.alias("r")).orderBy(F.col("r").asc_nulls_last(), "q").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_exact int")
    centroids = np.array([r.q for r in first], np.int64)
    for _ in range(rounds):
        sums = kept.mapInArrow(_sums(centroids, segments), "cluster int, pos int, s long")
        sums = {(r.cluster, r.pos): int(r.s) for r in sums.groupBy("cluster", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}  # k * (dim + 1) rows
        new = centroids.copy()
        for c in range(len(new)):
            if n := sums.get((c, -1)):
                new[c] = [sums[c, i] // n for i in range(dim)]
        if (new == centroids).all():
            break  # all later rounds would give the same
        centroids = new
    out = scratch.store(kept.mapInArrow(_assign(centroids, segments), "vec_id long, cluster int, distance long, n_exact int"), "assigned")
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digest[c]) for c in range(len(centroids))]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")  # k rows
