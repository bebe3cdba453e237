"""Clustering and top-k search against plain loops over exact integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from relmill.llm.centroid_clustering import centroid_clustering, compressed, nearest
from relmill.llm.top_k import NONE, best_of, exact_top_k, sample_rotation

NAN, INF = float("nan"), float("inf")


def spread(n, dim, seed, kinds=5):
    r = random.Random(seed)
    heads = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(kinds)]
    return [[x + r.gauss(0, 0.3) for x in heads[i % kinds]] for i in range(n)]


def whole(v, dim=None):
    return v is not None and (dim is None or len(v) == dim) and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if whole(v, dim)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centre = [q for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(centre)):
            mine = [q for (_, q), o in zip(kept, of, strict=True) if o == j]
            centre[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else centre[j]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = [sum(d for _, c, d in out if c == j) for j in range(len(centre))]
    return [(i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for i, c, d in out]


ODD = [(900, None), (901, []), (902, [1.0] * 7), (903, [None] + [0.5] * 7), (904, [NAN] + [0.5] * 7), (905, [INF] + [0.5] * 7), (906, [0.0] * 8)]


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_clustering_matches_plain(spark, rounds):
    rows = list(enumerate(spread(150, 8, 1))) + ODD + [(3, spread(150, 8, 1)[3]), (None, [0.25] * 8), (None, [-0.25] * 8)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    out = centroid_clustering(df, k=4, rounds=rounds, dim=8, segments=2)
    assert sorted(map(tuple, out.drop("n_exact").collect()), key=str) == sorted(plain_clusters(rows, 4, rounds, 8), key=str)


def test_clustering_few_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroid_clustering(spark.createDataFrame([], schema)).count() == 0
    assert centroid_clustering(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    same = [(i, [0.5] * 8) for i in range(12)]  # all centroids are equal: the first takes all, the others stay
    out = centroid_clustering(spark.createDataFrame(same, schema), k=4, dim=8).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in out} == {(0, 0, 0)}
    assert {r.cluster for r in centroid_clustering(spark.createDataFrame([(1, [0.5] * 8), (2, [4.0] * 8)], schema), dim=8).collect()} == {0, 1}
    with pytest.raises(Exception, match="no integer here"):
        centroid_clustering(spark.createDataFrame([(1, [1e9] * 8)], schema), dim=8).count()


def test_screening_prunes_and_never_misses():
    q = (np.array(spread(2_000, 64, 5, kinds=8)) * 1024).astype(np.int64)
    c = q[:8].copy()
    cluster, best, exact = nearest(q, compressed(q, 8), c, 8)
    full = ((q[:, None] - c[None]) ** 2).sum(2)
    assert (cluster == full.argmin(1)).all() and (best == full.min(1)).all()
    assert exact.mean() < 2  # of eight
    wide = q * 40_000
    assert (nearest(wide, compressed(wide, 8), wide[:8], 8)[0] == full.argmin(1)).all()


def plain_top(rows, queries, k):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and whole(v)]
    out = []
    for i, q in [(i, [math.floor(1024 * x) for x in v]) for i, v in queries if i is not None and whole(v)]:
        hits = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in kept if j != i and len(c) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(hits)]
    return out


@pytest.mark.parametrize("kind", ["lengths", "unit", "ties", "negative"])
def test_top_k_matches_plain(spark, kind):
    r = random.Random(kind)
    vectors = spread(230, 8, 3)
    if kind == "lengths":
        vectors = [[x * r.lognormvariate(0, 1) for x in v] for v in vectors]
    if kind == "unit":
        vectors = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vectors]
    if kind == "ties":
        vectors = [[float(r.randrange(2)) for _ in range(8)] for _ in vectors]
    if kind == "negative":
        vectors = [[abs(x) if i % 7 else -abs(x) for x in v] for i, v in enumerate(vectors)]
    rows = list(enumerate(vectors)) + ODD + [(5, vectors[5]), (None, vectors[6]), (907, [0.5, 0.25]), (908, []), (909, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "y") for i, v in rows], "vec_id long, embedding array<double>, rank int, q string").repartition(5)
    asked = [x for x in rows if x[0] is None or x[0] % 10 == 0 or x[0] > 900]
    q = df.where("vec_id is null or vec_id % 10 = 0 or vec_id > 900")
    got = [tuple(x) for x in exact_top_k(df, q, k=7, block_rows=40, slice_rows=16).collect()]
    assert sorted(got) == sorted(plain_top(rows, asked, 7))


def test_top_k_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0])], schema)
    assert exact_top_k(none, none).count() == exact_top_k(one, none).count() == exact_top_k(none, one).count() == exact_top_k(one, one).count() == 0


def test_rotation_prunes():
    r = np.random.default_rng(4)
    c = (r.normal(size=(4_000, 64)) * np.linspace(8, 0.1, 64) * 100 * r.lognormal(0, 0.5, (4_000, 1))).astype(np.int64)
    c = c[np.argsort(-(c * c).sum(1))]
    ids, q = np.arange(len(c)), c[::40]
    i, j, s, exact = best_of(q, ids[::40], np.full(len(q), NONE), c, ids, *sample_rotation(c[::5]), 10)
    full = q @ c.T
    full[np.arange(len(q)), ids[::40]] = NONE
    assert (np.sort(s.reshape(-1, 10)) == np.sort(full, 1)[:, -10:]).all()
    assert exact < 0.35 * len(q) * len(c)  # the first 1,024 vectors have no bound yet
