"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one row kept per group.

Equal vectors are collapsed first, so a group of copies costs one row. A bounded sample (``sample_rows``)
fits the centroids; every vector goes to its nearest cell and, near a border, to the few cells whose
centroid is almost as close, so a pair that a border parts still meets. Where more than ``most_cells`` cells are
needed, each is parted by a second codebook, of what is left of the sample's vectors without their centroids, so that
up to most_cells squared cells grow with the vectors while what is fitted and broadcast stays bounded. Inside a (label, cell) the
vectors are dealt to blocks of bounded size, and each task multiplies two blocks. A task returns link
counts and a spanning forest of its links, never the links themselves, so a hot group of n near copies
gives O(n) rows. Components of the forests are the groups.
"""

from __future__ import annotations

import sys
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.llm.common import known, known_or_named
from relmill.operators.components import connected_components
from relmill.staging import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors, started from k of the vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        size = np.sqrt((new * new).sum(1))
        c = np.where(size[:, None] > 0, new / np.maximum(size, 1e-300)[:, None], c)
    return c


def plain_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Euclidean centroids of vectors, started from k of them."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
    return c


def codebooks(x: np.ndarray, cells: int, most_cells: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Unit centroids for so many cells and, where that is more than ``most_cells``, a second codebook for the rest."""
    most = max(1, len(x) // 8)
    if cells <= most_cells:
        return spherical_kmeans(x, min(cells, most)), None
    first = spherical_kmeans(x, min(most_cells, most))
    rest = x - first[(x @ first.T).argmax(1)]
    return first, plain_kmeans(rest, min(-(-cells // len(first)), most_cells, most))


def visited(x: np.ndarray, centroids: np.ndarray, fine: np.ndarray | None, slack: float, most: int) -> list[list[int]]:
    """For unit vectors the cells to visit: the nearest and those whose cosine is within ``slack`` of it, at most ``most``;
    with a second codebook, in each of these the nearest parts, within twice ``slack`` in squared distance."""
    s = x @ centroids.T
    top = np.argsort(-s, 1)[:, :most]
    near = np.take_along_axis(s, top, 1)
    open_ = near >= near[:, :1] - slack
    if fine is None:
        return [t[o].tolist() for t, o in zip(top, open_, strict=True)]
    out: list[list[int]] = [[] for _ in x]
    for j in range(top.shape[1]):
        rows = np.flatnonzero(open_[:, j])
        rest = x[rows] - centroids[top[rows, j]]
        d = (fine * fine).sum(1) - 2 * (rest @ fine.T)
        own = np.argsort(d, 1)[:, :most]
        close = np.take_along_axis(d, own, 1)
        for i, c, o, ok in zip(rows.tolist(), top[rows, j].tolist(), own, close <= close[:, :1] + 2 * slack, strict=True):
            out[i] += (c * len(fine) + o[ok]).tolist()
    return out


def _cells(centroids: np.ndarray, fine: np.ndarray | None, slack: float, most: int):
    def run(it):
        for pdf in it:
            cells = [[0]] * len(pdf)  # vectors of another length than the centroids' share one cell
            own = np.flatnonzero(pdf.v.map(len).to_numpy() == centroids.shape[1])
            if len(own):
                for i, c in zip(own.tolist(), visited(unit(np.array(pdf.v.iloc[own].tolist(), float)), centroids, fine, slack, most), strict=True):
                    cells[i] = c
            pdf = pdf.assign(cells=cells)
            yield pdf[["id", "n", "part", "v", "cells"]]

    return run


def reaches(a, b, threshold: float) -> bool:
    """Whether the cosine is at least ``threshold``, in exact arithmetic."""
    a, b = ([Fraction(float(x)) for x in v] for v in (a, b))
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return (dot * abs(dot) - Fraction(threshold) * abs(Fraction(threshold)) * sum(x * x for x in a) * sum(x * x for x in b)) >= 0


def _links(threshold: float, doubt: float = 1e-12):
    """Counts and a spanning forest of the links between two blocks, or inside one."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            cell, same = int(left.cell.iat[0]), int(left.i.iat[0]) == int(left.j.iat[0])
            ids, n = [d.id.to_numpy() for d in (left, right)], [d.n.to_numpy() for d in (left, right)]
            x = [unit(np.array(d.v.tolist(), float)) for d in (left, right)]
            cosine = x[0] @ x[1].T
            for i, j in np.argwhere(np.abs(cosine - threshold) <= doubt).tolist():  # rounding could decide these
                cosine[i, j] = 2 if reaches(left.v.iat[i], right.v.iat[j], threshold) else -2
            a, b = np.nonzero(cosine >= threshold)
            if same:
                a, b = a[ids[0][a] < ids[1][b]], b[ids[0][a] < ids[1][b]]
            # a pair that meets in several cells belongs to the first of them
            width = max(max(map(len, d.cells)) for d in (left, right))
            pads = [np.array([[*c, *[f] * (width - len(c))] for c in d.cells]) for d, f in ((left, -1), (right, -2))]
            if width > 1 and len(a):
                shared = pads[0][a][:, :, None] == pads[1][b][:, None, :]
                first = np.where(shared.any(2), pads[0][a], np.iinfo(np.int64).max).min(1)
                a, b = a[first == cell], b[first == cell]
            if len(a):
                at, totals = np.unique(np.concatenate([ids[0][a], ids[1][b]]), return_inverse=True)
                counts = np.bincount(totals, np.concatenate([n[1][b], n[0][a]])).astype(np.int64)
                out.append(pd.DataFrame({"a": at, "b": pd.NA, "n": counts}))
                u, v = totals[: len(a)], totals[len(a) :]
                root = np.arange(len(at))
                while True:  # smallest label over the links, to a fixed point
                    new = root.copy()
                    np.minimum.at(new, u, root[v])
                    np.minimum.at(new, v, root[u])
                    new = np.minimum(new, new[new])
                    if (new == root).all():
                        break
                    root = new
                tied = root != np.arange(len(at))
                out.append(pd.DataFrame({"a": at[tied], "b": at[root[tied]], "n": 0}))
        return pd.concat(out).astype({"b": "Int64"}) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": pd.array([], "Int64"), "n": np.zeros(0, np.int64)})

    return run


def embedding_dedup(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    sample_rows: int = 20_000,
    per_cell: int = 2_000,
    most_cells: int = 512,
    slack: float = 0.12,
    probes: int = 3,
    block: int = 1_024,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Only rows with equal, non-null labels and vectors of equal length are compared. A vector that is
    null, empty, zero or holds a null or non-finite component links with nothing and is kept. Ids are
    taken as unique and below 2^62, a repeated row counting as a copy of itself. Rows with a null id link as any other; their
    component is the smallest id that is known, or null, and they are kept where no id is known. An empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    label, v = F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>")
    rows = vectors.select(known_or_named(F.col(id_col), label, v).alias("vec_id"), label.alias("label"), v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("label").isNotNull() & (F.size("v") > 0) & whole)
    part = F.concat_ws("|", F.col("label"), F.size("v").cast("string"))
    reps = scratch.store(valid.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).select("label", "id", "n", part.alias("part"), "v"), "vectors")
    total = reps.count()
    if not total:
        return rows.select(known("vec_id"), F.lit(0).cast("long").alias("n_links"), known(F.col("vec_id")).alias("component_id"), F.lit(True).alias("kept"))
    dim = reps.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    sample = reps.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()
    x = unit(np.array(sample.v.tolist(), float))
    centroids, fine = codebooks(x, max(1, -(-total // per_cell)), most_cells)
    placed = reps.select("id", "n", "part", "v").mapInPandas(_cells(centroids, fine, slack, probes), "id long, n long, part string, v array<double>, cells array<long>")
    placed = scratch.store(placed.withColumn("cell", F.explode("cells")), "cells")
    sizes = placed.groupBy("part", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 0")
    sizes = scratch.store(sizes, "blocks")
    dealt = placed.join(sizes, ["part", "cell"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block k is the left side with all blocks from k on, and the right side with all blocks up to k
    left = dealt.withColumn("j", F.explode(F.sequence("k", F.col("blocks") - 1))).withColumn("i", F.col("k"))
    right = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumn("j", F.col("k"))
    cols, keys = ["part", "cell", "i", "j", "id", "n", "v", "cells"], ["part", "cell", "i", "j"]
    found = left.select(cols).toDF(*cols).groupBy(keys).cogroup(right.select(cols).toDF(*cols).groupBy(keys)).applyInPandas(_links(threshold), "a long, b long, n long")
    found = scratch.store(found, "links")
    groups = scratch.store(connected_components(found.where("b is not null"), scratch), "groups")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    classes = reps.join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    classes = scratch.store(
        classes.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")), "classes"
    )
    keep = F.coalesce("component_id", "vec_id")
    return rows.join(classes, ["label", "v"], "left").select(known("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), known(keep).alias("component_id"), (keep == F.col("vec_id")).alias("kept"))
