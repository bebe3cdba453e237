"""Operators that SQL cannot state: communities, training, saved databases, checks that raise."""

import math
import random

import pytest
from pyspark.sql import functions as F

from relmill.functions.features import encoded_rows, feature_columns
from relmill.operators import communities, paths, tasks, validation
from relmill.operators.analytics import bfs_levels, modularity
from relmill.plans import training
from relmill.schema import ForeignKey, RelationalDB
from relmill.sources import tables as sources


@pytest.fixture(scope="module")
def cliques(spark):
    """Three cliques of six in a ring of single edges, and a vertex alone."""
    edges = [(10 * c + i, 10 * c + j) for c in range(3) for i in range(6) for j in range(i)] + [(0, 10), (11, 20), (21, 1)]
    v = [10 * c + i for c in range(3) for i in range(6)] + [99]
    return spark.createDataFrame([(x,) for x in v], "id long"), spark.createDataFrame(edges, "src long, dst long")


def test_louvain_finds_cliques(spark, cliques):
    v, e = cliques
    out = communities.louvain(v, e)
    got = {r.id: r.community for r in out.collect()}
    assert got == {i: i // 10 * 10 for i in got} | {99: 99} and len(got) == 19
    q = modularity(out.withColumnRenamed("community", "label"), e).first()[0]
    assert q > 0.5
    assert communities.louvain(v, e.limit(0)).where("id <> community").count() == 0


def test_spectral_clusters(spark):
    edges = [(10 * c + i, 10 * c + j) for c in range(2) for i in range(5) for j in range(i)]
    got = {r.id: r.cluster for r in communities.spectral_clusters(spark.createDataFrame(edges + [(0, 10)], "src long, dst long"), 2, 10).collect()}
    assert set(got) == {10 * c + i for c in range(2) for i in range(5)} and set(got.values()) <= {0, 1}


def test_paths_follow_predecessors(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (7, 8)], "src long, dst long")
    found = bfs_levels(e, spark.createDataFrame([(1,)], "id long"))
    got = {r.target: r.path for r in paths.paths(found).collect()}
    assert got == {1: [1], 2: [1, 2], 4: [1, 4], 3: [1, 2, 3], 5: [1, 2, 3, 5]}
    wanted = spark.createDataFrame([(1, 5), (1, 8)], "source long, target long")
    assert [r.path for r in paths.paths(found, wanted).collect()] == [[1, 2, 3, 5]]


def test_training_stops_early_and_keeps_the_best(spark, tmp_path):
    r = random.Random(1)
    rows = []
    for i in range(600):
        x = [r.gauss(0, 1) for _ in range(3)]
        label = int(x[0] - 0.5 * x[1] + r.gauss(0, 0.5) > 0)
        rows.append((("train", "train", "valid", "test")[i % 4], x, label))
    df = spark.createDataFrame(rows, "split string, x array<double>, label int")
    seen = []
    head = training.fit(df, epochs=12, rate=0.3, patience=3, each=seen.append)
    assert seen == head.log and head.log[-1]["loss"] < head.log[0]["loss"]
    from relmill.functions.metrics import roc_auc

    assert roc_auc(head.score(df.where("split = 'test'"))).first()[0] > 0.85  # the floor for such labels is 0.6
    assert roc_auc(head.score(df.where("split = 'valid'"))).first()[0] == pytest.approx(max(e["valid"] for e in head.log))
    head.save(spark, f"{tmp_path}/head.json")
    assert training.Head.load(spark, f"{tmp_path}/head.json") == head
    table = training.log_table(spark, head)
    assert [x.best for x in table.orderBy("epoch").collect()] == sorted(x.best for x in table.collect())
    training.save_metrics(table, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/metrics.json")).count() == len(head.log)
    with pytest.raises(ValueError, match="loss"):
        training.fit(df.withColumn("x", F.array(F.lit(float("nan")))), epochs=2)
    stop = training.EarlyStop(2, 0.1)
    assert [stop.better(x) for x in (1.0, 1.05, 1.2, 1.0, 1.0)] == [True, False, True, False, False] and stop.over


def test_database_is_saved_with_its_keys(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0, "x"), (2, 4.0, None)], "id long, size double, note string")
    b = spark.createDataFrame([(7, 1, 5.0), (8, None, 6.0)], "id long, a_id long, at double")
    db = RelationalDB("two", {"a": a, "b": b}, [ForeignKey("b", "a_id", "a")], {"a": "id", "b": "id"}, {"b": "at"})
    sources.save_database(db, str(tmp_path / "db"), version="3")
    back, meta = sources.load_database(spark, str(tmp_path / "db"))
    assert meta == {"version": "3"} and back.foreign_keys == db.foreign_keys and back.times == db.times
    assert sorted(map(tuple, back.tables["b"].collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert feature_columns(db, "b") == [] and feature_columns(db, "a") == ["size", "note"]
    assert {r.key: r.x for r in encoded_rows(db, "a").collect()} == {1: [-1.0], 2: [1.0]}
    assert len(encoded_rows(db, "b", t_max=6.0).first().x) == 7


def test_checks_that_raise(spark):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError, match="empty"):
        validation.require_rows(empty, "t", ["b"])
    with pytest.raises(ValueError, match="no column b"):
        validation.require_rows(spark.createDataFrame([(1,)], "a int"), "t", ["a", "b"])
    with pytest.raises(ValueError, match="missing tables: x, y"):
        validation.require({"z": empty}, ["y", "x", "z"])
    assert validation.check_dataset("n", "", "1", {}, "2023-01-01", "2023-01-01") == ["description is empty", "tables is empty", "the test time is not after the validation time"]
    assert validation.check_dataset("n", "d", "1", {"t": empty}, "2023-01-01", "2023-02-01") == []


def test_poisson_draws(spark):
    df = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    for rate in (0.5, 3.0, 40.0):
        got = [r[0] for r in df.select(tasks.poisson(F.lit(rate), F.col("u"))).collect()]
        mean = sum(got) / len(got)
        assert abs(mean - rate) < 0.05 + 0.01 * rate and abs(sum((x - mean) ** 2 for x in got) / len(got) - rate) < 0.1 + 0.03 * rate
        assert got == sorted(got) and got.count(0) == pytest.approx(4000 * math.exp(-rate), abs=2)
    assert df.select(F.sum(tasks.poisson(F.lit(-1.0), F.col("u")))).first()[0] == 0


def test_robust_scaling_ignores_how_values_repeat(spark):
    from relmill.functions.features import robust

    values = [1.0, 1.0, 2.0, 4.0, 8.0, 16.0, None]
    out = {r.x: r.y for r in robust(spark.createDataFrame([(v,) for v in values], "x double"), "x", "y").collect()}
    # quartiles at positions 1.25, 2.5 and 3.75 of six
    assert out[16.0] == pytest.approx((16 - 3.0) / (7.0 - 1.25)) and out[None] is None


def test_scratch_tables_are_shared():
    from relmill.staging import shared_warehouse

    for path, master in (("file:/tmp/w", "local[4]"), ("/tmp/w", "local"), ("hdfs://x/w", "yarn"), ("s3a://x/w", "spark://h:7077")):
        assert shared_warehouse(path, master) == path
    for path, master in (("file:/tmp/w", "yarn"), ("/tmp/w", "spark://h:7077"), ("file:///w", "local-cluster[2,1,1024]")):
        with pytest.raises(RuntimeError, match="checkpoint.dir"):
            shared_warehouse(path, master)
