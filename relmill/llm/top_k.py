"""Exact top-k inner products by norm order and rotated partial sums (after FEXIPRO of Li et al., 2017).

Vectors are ranked by descending length and cut into blocks. Waves take the blocks in that order, each wave about
as many as all before it. After a wave every query has the k best scores so far; a query leaves when its length times the
longest vector that is still to come cannot reach its k-th score, since |q . c| <= |q| |c|.

Within a block, vectors are rotated so that the first dimensions hold most of their length; the rotation comes from the
singular vectors of a bounded sample. A pair's products are summed over the first dimensions, the rest is bounded by the
product of the two remainders' lengths, then over some more dimensions; only pairs that can still reach the query's k-th
score get an exact integer product. The rotation only sharpens the bounds: any rotation gives the same answers.

A task holds one block of vectors and reads one slice of the queries in batches, so neither side is ever whole in a task.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relmill.llm.centroid_clustering import integers, whole
from relmill.operators.ordered import row_index
from relmill.staging import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NONE = np.iinfo(np.int64).min
#: Vectors of a block, and queries of a batch, that are multiplied at once; pairs that get exact products at once.
CHUNK, BATCH, PAIRS = 1_024, 512, 32_768


def lists(column) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).cumsum()
    return np.split(values.astype(np.int64, copy=False), ends[:-1])


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of two lists of rows, pair by pair."""
    out = np.empty(len(q), np.int64)
    for lo in range(0, len(q), PAIRS):
        out[lo : lo + PAIRS] = np.einsum("ij,ij->i", q[lo : lo + PAIRS], c[lo : lo + PAIRS])
    return out


def best_of(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, c: np.ndarray, c_ids: np.ndarray, rotation: np.ndarray, cuts: tuple[int, ...], k: int):
    """(query's place, vector's place, score) of at most k best pairs of each query in one block, sorted by descending
    length, that reach the query's ``least`` score; ties to the smaller id. The last value counts exact products."""
    rq, rc = q @ rotation, c @ rotation
    q_size, c_size = np.sqrt((rq * rq).sum(1)), np.sqrt((rc * rc).sum(1))
    tail = lambda x, at: np.sqrt((x[:, at:] * x[:, at:]).sum(1))
    need = least.astype(float)
    found = [np.zeros((3, 0), np.int64)]
    exact = 0
    for lo in range(0, len(c), CHUNK):
        part = slice(lo, min(lo + CHUNK, len(c)))
        slack = 1e-9 * q_size * c_size[lo] + 1e-3  # rounding never drops a pair
        live = np.flatnonzero(q_size * c_size[lo] + slack >= need)
        if not len(live):
            break  # later vectors are shorter still
        head = rq[live, : cuts[0]] @ rc[part, : cuts[0]].T
        bound = head + tail(rq[live], cuts[0])[:, None] * tail(rc[part], cuts[0])
        i, j = np.nonzero(bound + slack[live, None] >= need[live, None])
        partial = head[i, j]
        for at, to in zip(cuts, cuts[1:], strict=False):
            some = np.concatenate([np.einsum("ij,ij->i", rq[live[i[x : x + PAIRS]], at:to], rc[lo + j[x : x + PAIRS], at:to]) for x in range(0, len(i), PAIRS)] or [np.zeros(0)])
            partial = partial + some
            ok = partial + tail(rq[live], to)[i] * tail(rc[part], to)[j] + slack[live[i]] >= need[live[i]]
            i, j, partial = i[ok], j[ok], partial[ok]
        i, j = live[i], j + lo
        other = q_ids[i] != c_ids[j]
        i, j = i[other], j[other]
        s = scores(q[i], c[j])
        exact += len(s)
        ok = s >= least[i]
        old = np.concatenate([*found, np.stack([i[ok], j[ok], s[ok]])], 1)
        order = np.lexsort((c_ids[old[1]], -old[2], old[0]))
        old = old[:, order]
        begin = np.searchsorted(old[0], np.arange(len(q)))
        place = np.arange(old.shape[1]) - begin[old[0]]
        found = [old[:, place < k]]
        kth = found[0][:, place[place < k] == k - 1]
        need[kth[0]] = np.maximum(need[kth[0]], kth[2])
    return *found[0], exact


def _search(rotations: dict[int, tuple[np.ndarray, tuple[int, ...]]], k: int):
    """Rows come by (block, slice), a block's vectors before its queries; yields (query, row, id, score)."""

    def rotation(dim: int):
        return rotations.get(dim) or (np.eye(dim), (max(1, dim // 4),))

    def run(batches):
        now, held, ready = None, [], None
        for b in batches:
            keys = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("block", "slice", "kind")])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if b.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                for at in range(lo, hi, BATCH):
                    part = b.slice(at, min(BATCH, hi - at))
                    block, piece, kind = keys[:, lo].tolist()
                    if (block, piece) != now:
                        now, held, ready = (block, piece), [], None
                    ids, qs = part.column("id").to_numpy(zero_copy_only=False), lists(part.column("q"))
                    if kind == 0:
                        held.append((ids, qs))
                        continue
                    if not held:
                        continue
                    if ready is None:
                        every = [x for _, xs in held for x in xs]
                        ready = {}
                        c_ids, dims = np.concatenate([i for i, _ in held]), np.array([len(x) for x in every])
                        for dim in np.unique(dims).tolist():  # vectors of other lengths have no product
                            at_dim = np.flatnonzero(dims == dim)
                            ready[dim] = c_ids[at_dim], np.array([every[x] for x in at_dim], np.int64).reshape(len(at_dim), dim)
                    row, least = part.column("row").to_numpy(zero_copy_only=False), part.column("least").fill_null(NONE).to_numpy(zero_copy_only=False)
                    sizes = np.array([len(x) for x in qs])
                    for dim in np.unique(sizes).tolist():
                        if dim not in ready:
                            continue
                        own = np.flatnonzero(sizes == dim)
                        q = np.array([qs[x] for x in own], np.int64).reshape(len(own), dim)
                        c_ids, c = ready[dim]
                        if dim == 0:
                            i, j = np.nonzero(ids[own][:, None] != c_ids[None, :])
                            order = np.lexsort((c_ids[j], i))
                            i, j = i[order], j[order]
                            first = np.arange(len(i)) - np.searchsorted(i, i) < k
                            i, j, s = i[first], j[first], np.zeros(first.sum(), np.int64)
                        else:
                            i, j, s, _ = best_of(q, ids[own], least[own], c, c_ids, *rotation(dim), k)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(row[own][i]), pa.array(ids[own][i]), pa.array(c_ids[j]), pa.array(s)], ["row", "query_id", "vec_id", "score"])

    return run


def sample_rotation(sample: np.ndarray, shares: tuple[float, ...] = (0.6, 0.9)) -> tuple[np.ndarray, tuple[int, ...]]:
    """Right singular vectors of a sample, the longest first, and the dimensions that hold these shares of its length."""
    x = sample.astype(float)
    _, energy, v = np.linalg.svd(x.T @ x)  # its singular vectors are the sample's right ones, its values their squares
    part = np.cumsum(energy) / max(energy.sum(), 1e-300)
    cuts = sorted({min(max(1, int(np.searchsorted(part, s)) + 1), sample.shape[1]) for s in shares})
    return v.T, tuple(cuts)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 20_000, block_rows: int | None = None, slice_rows: int = 32_768) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best integer inner products of each query, ties to the smaller id.

    Both tables hold ids and vectors; a query's own id is no candidate. Null vectors, and those that hold a null or a
    component that is not finite, take no part, nor do null ids; products are of vectors of one length. A repeated
    candidate counts again, a repeated query row is answered again. A component of 131,072 or more is an error. A query
    with fewer candidates gets all of them; empty tables give an empty result; other columns are not read. The rotation is
    fitted on ``sample_rows`` vectors of the most common length; it changes the work, never the answers.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole(F.col("v"))).select("id", integers(F.col("v")).alias("q"))
        return rows.withColumn("size", F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)))

    ranked = scratch.store(row_index(clean(vectors), [F.desc("size"), "id", "q"], "place"), "by-length")
    asked = scratch.store(row_index(clean(queries), [F.desc("size"), "id", "q"], "row"), "queries")
    total, n_asked = ranked.count(), asked.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total or not n_asked:
        return empty
    rows = block_rows or int(np.clip(-(-total // 64), 1_024, 32_768))
    dim = ranked.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    sample = ranked.where(F.size("q") == dim).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("q").collect()
    rotations = {dim: sample_rotation(np.array([r.q for r in sample], np.int64))} if dim else {}
    blocks, slices = -(-total // rows), -(-n_asked // slice_rows)
    best, lo, hi = None, 0, 1
    live = asked.withColumn("least", F.lit(None).cast("long"))
    while lo < blocks:
        here = ranked.where((F.col("place") >= lo * rows) & (F.col("place") < hi * rows)).withColumn("block", F.floor(F.col("place") / rows))
        held = here.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), F.col("place").alias("row"), "id", F.lit(None).cast("long").alias("least"), "q")
        sent = live.select(F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(min(hi, blocks) - 1).cast("long"))).alias("block"), F.floor(F.col("row") / slice_rows).cast("int").alias("slice"), F.lit(1).alias("kind"), "row", "id", "least", "q")
        dealt = held.unionByName(sent).repartition((min(hi, blocks) - lo) * slices, "block", "slice").sortWithinPartitions("block", "slice", "kind", "row")
        new = dealt.mapInArrow(_search(rotations, k), "row long, query_id long, vec_id long, score long")
        new = new if best is None else new.unionByName(best.drop("rank"))
        w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
        best = scratch.store(new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), f"best-{lo}")
        lo, hi = hi, 2 * hi + 1
        if lo < blocks:
            longest = ranked.where(F.col("place") == lo * rows).first()["size"]
            full = best.where(F.col("rank") == k).select("row", F.col("score").alias("least"))
            # a vector as long as the longest to come could still tie with the k-th, so equality stays in
            live = asked.join(full, "row", "left").where(F.col("least").isNull() | (F.col("size") * longest * (1 + 1e-9) + 1e-3 >= F.col("least")))
    return best.select("query_id", "rank", "vec_id", "score")
