"""As many rows out as in on repeated and null ids; long lists of rules."""

import time

import pytest
from pyspark.sql import functions as F

from relmill.llm import queries, url_filter
from relmill.llm.embedding_dedup import embedding_dedup
from relmill.llm.jaccard_join import jaccard_groups
from relmill.llm.repeats import remove_repeats


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """All tables with repeated and null ids."""
    path = str(tmp_path_factory.mktemp("odd"))
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "x y"), (1, "x y"), (2, text), (None, "y"), (None, text), (3, None), (4, ""), (None, None), (5, text + " end")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.net/es/", None), (1, "http://a.net/es/", None), (None, None, None), (None, "http://b.com/", "x")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    v = [1.0] + [0.0] * 63
    spark.createDataFrame([(1, v, 0), (1, v, 0), (None, v, 0), (None, [0.5] * 64, 0), (7, None, 1), (None, None, None)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_interpolated_lm", "op3_exact_dedup", "op4_repeated_passages", "op5_jaccard_join", "op6_pfair_mixing", "op9_embedding_dedup", "op10_toxicity"])
def test_a_row_for_every_row(spark, odd, name):
    path, rows = odd
    n = {"op1_url_filter": 4, "op9_embedding_dedup": 6}.get(name, len(rows))
    out = queries.QUERIES[name](spark, path)
    ids = [r[0] for r in out.select(out.columns[0]).collect()]
    assert len(ids) == n
    assert ids.count(None) == {"op1_url_filter": 2, "op9_embedding_dedup": 3}.get(name, 3)


def test_null_ids_take_part(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    got = sorted((tuple(r) for r in jaccard_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 196, 2), (None, 1, None), (None, 196, 2), (3, 0, 3), (4, 0, 4), (None, 0, None), (5, 197, 2)], key=str)
    cut = {(r.doc_id, r.n_bytes): r.n_removed for r in remove_repeats(docs).collect()}
    n = len(" ".join(f"w{i}" for i in range(200)))
    assert cut[2, n] == cut[None, n] == cut[5, n + 4] == n
    v = spark.read.parquet(f"{odd[0]}/embeddings.parquet")
    got = sorted((tuple(r) for r in embedding_dedup(v).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (7, 0, 7, True), (None, 0, None, True)], key=str)


def test_many_rules(spark, monkeypatch):
    """A list of 100,000 rules is planned in seconds; broadcast or not, the longest fitting rule wins."""
    began = time.perf_counter()
    rules = spark.range(100_000).select(F.concat(F.lit("h"), F.col("id") % 50_000, F.lit(".org")).alias("host"), F.when(F.col("id") < 50_000, "/").otherwise("/a/").alias("path"), F.when(F.col("id") < 50_000, "block").otherwise("allow").alias("action"))
    pages = spark.createDataFrame([(1, "http://h7.org/x"), (2, "http://www.h7.org/a/x"), (3, "http://h7.org.uk/a/"), (4, "http://xh7.org/a/"), (5, "http://a.b.h49999.org/"), (6, None)], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    want = {1: ("h7.org/", "block"), 2: ("h7.org/a/", "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("h49999.org/", "block"), 6: (None, "allow")}
    out = url_filter.url_filter(pages, rules)
    assert time.perf_counter() - began < 60
    assert {r.page_id: (r.rule, r.verdict) for r in out.collect()} == want
    monkeypatch.setattr(url_filter, "FEW", 0)
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()} == want
    assert {r.verdict for r in url_filter.url_filter(pages, []).collect()} == {"allow"}
