"""Near vectors in many cells: recall against brute force at the defaults, and the exact setting."""

import numpy as np
import pytest

from relmill.llm.embedding_dedup import codebooks, embedding_dedup, unit, visited


def made(n, dim=64, seed=2):
    """Families of near copies around clustered heads, cosines from about 0.9 to 1."""
    r = np.random.default_rng(seed)
    clusters = r.normal(size=(40, dim))
    heads = clusters[r.integers(0, 40, n // 3)] + 0.8 * r.normal(size=(n // 3, dim))
    x = unit(heads[r.integers(0, len(heads), n)])
    return unit(x + r.uniform(0.005, 0.055, (n, 1)) * r.normal(size=(n, dim)))


@pytest.mark.parametrize(("per_cell", "most_cells"), [(60, 512), (20, 24)])
def test_recall_with_many_cells(spark, per_cell, most_cells):
    """50 cells of one level, and 150 of two, against all pairs."""
    x = made(3_000)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup(df, per_cell=per_cell, most_cells=most_cells).collect()}
    links = x @ x.T >= 0.93
    np.fill_diagonal(links, False)
    want = links.sum(1)
    assert want.sum() > 2_000 and all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.9 * want.sum()


def test_two_levels_are_exact_where_asked(spark):
    x = made(400, dim=8)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup(df, per_cell=10, most_cells=6, slack=4, probes=36).collect()}
    links = x @ x.T >= 0.93
    assert got == {i: int(links[i].sum()) - 1 for i in range(len(x))}


def test_codebooks_are_bounded():
    x = made(2_000)
    first, fine = codebooks(x, 10_000, 64)
    assert len(first) == 64 and len(fine) == 64
    cells = [c for own in visited(x, first, fine, 0.12, 3) for c in own]
    assert len(set(cells)) > 500 and max(cells) < 64 * 64
    assert codebooks(x, 30, 64)[1] is None and len(codebooks(x[:3], 30, 64)[0]) == 1
