"""Every registered query of the relational operators against its SQL, on the smallest tables."""

import pytest

from relmill.plans import checks as catalog  # the catalogue and its extensions

SF = "/root/testdata/sf0.001"


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].astype(object).map(str).to_numpy().tolist())), cols


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


def test_graph_queries_are_whole(spark, tmp_path):
    # customers of one nation in a row of steps of 128, beyond 12 hops and a distance of 400, and three in steps of 1
    ids = [1 + 128 * i for i in range(16)]
    rows = [(i, 1) for i in ids] + [(i, 2) for i in (500, 501, 502)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {n: {r[0]: r[1] for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("closeness", "bfs_levels", "shortest_paths", "greedy_colouring")}
    # 500 to 502 are joined in both steps, 1 and 2; the nations' sources are 1 and 500
    assert got["bfs_levels"] == {i: k for k, i in enumerate(ids)} | {500: 0, 501: 1, 502: 1}
    assert got["shortest_paths"] == {i: 128.0 * k for k, i in enumerate(ids)} | {500: 0.0, 501: 1.0, 502: 2.0}
    assert got["greedy_colouring"] == {i: k % 2 for k, i in enumerate(ids)} | {500: 0, 501: 1, 502: 2}
    want = {a: 15 / sum(abs(j - k) for j in range(16)) for k, a in enumerate(ids)} | {500: 1.0, 501: 1.0, 502: 1.0}
    assert got["closeness"] == pytest.approx(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 150
    assert set(e.oracle_sql()) <= set(e.queries())
