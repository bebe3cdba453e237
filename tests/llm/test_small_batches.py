"""Arrow functions on batches of very few words, and registered queries on repeated and null ids."""

import numpy as np
import pyarrow as pa
import pytest

from relmill.llm import queries
from relmill.llm.common import word_hashes
from relmill.llm.jaccard_join import LOW, jaccard_groups, shingles

TEXTS = ["", "one", "one two", "one two three", "a b c d", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("text", TEXTS)
def test_shingles_of_one_row(text):
    alone = shingles(pa.array([text]))
    among = shingles(pa.array([text, " ".join(map(str, range(40)))]))
    assert (alone == among[among >> np.uint64(LOW) == 0]).all()
    n = len(text.split())
    assert len(alone) == (max(1, n - 4) if n else 0)
    assert len(word_hashes(pa.array([text]))[0]) == n


def test_shingles_of_short_rows():
    whole = shingles(pa.array(TEXTS * 2 + ["x y " * 30]))
    half = np.uint64(len(TEXTS) << LOW)
    first, second = whole[whole < half], whole[(whole >= half) & (whole < half + half)]
    assert (first + half == second).all()


def test_jaccard_with_short_last_batch(spark):
    rows = [(i, f"w{i} a{i} b{i} c{i} d{i}") for i in range(10_000)] + [(10_000, "two words"), (10_001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = jaccard_groups(docs)
    assert out.count() == len(rows)
    assert out.where("doc_id <> component_id").count() == 0
    assert {r.doc_id: r.n_shingles for r in out.where("doc_id >= 9999").collect()} == {9999: 1, 10_000: 1, 10_001: 0}


def test_exact_query_on_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "x"), (1, "x"), (2, "x"), (None, "y"), (None, "x"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in queries.op3_exact_dedup(spark, str(tmp_path)).collect()]
    want = [(1, 2, 3, False)] * 2 + [(2, 2, 3, True), (3, 4, 2, False), (4, 4, 2, True)] + [(None, None, 1, True)] * 2
    assert sorted(out, key=str) == sorted(want, key=str)
