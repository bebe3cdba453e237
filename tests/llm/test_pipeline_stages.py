"""Stages of the pipeline on odd tables, and near copies from end to end."""

import random

import pytest

import corpus_pipeline as cp

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefghijklmnopqrst") for _ in range(R.randint(3, 9))) for _ in range(4000)]
#: Columns whose names the stages use for their own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, id string, score double, _slot long, component_id long, h1 long"


def say(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def table(spark, path, rows, labels=((0, 1, 0), (1, 1, 1))):
    rows = [(i, t, "en", s, len(t) if t is not None else None, "r", 1, "i", 0.5, 7, 8, 9) for i, t, s in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_odd_rows_pass_every_stage(spark, tmp_path):
    text = say(40)
    rows = [(1, text, "src0"), (1, text, "src0"), (2, None, None), (3, "", "src1"), (4, say(30), "nowhere"), (None, say(25), "src2"), (5, " \n\t", "src0"), (6, "one", "src3"), (7, say(30000), "src1")]
    docs = table(spark, tmp_path, rows)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert out.columns == docs.columns and {r.h1 for r in out.collect()} == {9}
        # nothing here is toxic or like another one, so every stage keeps every row
        assert got == sorted(((i, t) for i, t, _ in rows), key=str), name
    pieces = cp.packing_stage(spark, docs, str(tmp_path)).collect()
    assert sum(p.doc_id == 1 for p in pieces) == 2 and sum(p.doc_id is None for p in pieces) == 1 and sum(p.doc_id == 7 for p in pieces) > 10


def test_empty_table_passes_every_stage(spark, tmp_path):
    docs = table(spark, tmp_path, [(1, "x", "src0")]).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


@pytest.mark.parametrize("lines", [1, 6])
def test_near_copies_are_caught_from_end_to_end(spark, tmp_path, lines):
    """Of each planted group one document stays whole or nearly so, and strangers all stay."""
    rows = []
    for g in range(12):
        base = [say(30) for _ in range(lines)]
        for k in range(4):
            rows.append((100 * g + k, "\n".join(" ".join(R.choice(WORDS) if R.random() < 0.02 * k else w for w in x.split()) for x in base), f"src{g}"))
    strangers = [(5000 + i, "\n".join(say(25) for _ in range(lines)), "src1") for i in range(20)]
    docs = table(spark, tmp_path, rows + strangers)
    kept = docs
    for _, stage in cp.STAGES[1:3]:
        kept = stage(spark, kept, str(tmp_path)).cache()
    ids = {r.doc_id: r.text for r in kept.collect()}
    assert all(100 * g in ids and ids[100 * g] == rows[4 * g][1] for g in range(12))
    assert all(i in ids and ids[i] == t for i, t, _ in strangers)
    words = sum(len(t.split()) for i, t in ids.items() if i < 5000)
    assert words <= 1.1 * 12 * 30 * lines  # what is left of the copies
