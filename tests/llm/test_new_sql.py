"""Clustering, top-k search and conversation repair against their SQL."""

import pytest

from relmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_exact_top_k", "op13_conversation_repair"])
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want.select(*cols).fetchall(), key=str)
