"""As-of joins, key discovery and stream state against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relmill.operators.asof import asof_join
from relmill.operators.discovery import column_profile, column_values, discover, inclusions
from relmill.staging import Scratch
from relmill.streaming.state import merged, node_activity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 40])
def test_asof(spark, strict, parts):
    r = random.Random(parts)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    versions = [(key(), r.randrange(200) if r.random() < 0.97 else None, i, r.random()) for i in range(400)]
    seeds = [(key(), r.randrange(-5, 205) if r.random() < 0.97 else None, f"s{i // 2}") for i in range(600)]  # some repeated
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        v = spark.createDataFrame(versions, "k string, at int, version int, x double")
        s = spark.createDataFrame(seeds, "k string, at int, name string")
        got = [tuple(x) for x in asof_join(s, v, ["k"], "at", ["x"], ["version"], strict).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def last(k, at):
        fits = [(t, n, x) for key, t, n, x in versions if key == k and None not in (k, at, t) and (t < at if strict else t <= at)]
        return max(fits)[2] if fits else None

    assert sorted(got, key=str) == sorted(((k, at, n, last(k, at)) for k, at, n in seeds), key=str)


def test_asof_of_nothing(spark):
    s, v = spark.createDataFrame([(1, 2)], "k int, at int"), spark.createDataFrame([], "k int, at int, x int")
    assert [tuple(x) for x in asof_join(s, v, ["k"], "at", ["x"]).collect()] == [(1, 2, None)]
    assert asof_join(s.limit(0), v, ["k"], "at", ["x"]).count() == 0
    with pytest.raises(ValueError, match="columns of both"):
        asof_join(s, v, ["k"], "at", ["at"])


def test_discovered_database(spark):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    db = discover("found", {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in names})
    assert db.keys == {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
    got = {(k.table, k.column, k.target) for k in db.foreign_keys}
    assert got == {
        ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"),
        ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("lineitem", "l_suppkey", "supplier"),
    }
    db.check()


def test_inclusions_of_odd_columns(spark):
    a = spark.createDataFrame([(1, "x", None, 1.5, True), (2, "y", None, 2.5, False), (3, None, None, 3.5, True)], "id int, name string, empty int, f double, b boolean")
    b = spark.createDataFrame([(1, "x" * 100), (2, "x" * 100), (2, "y"), (None, None)], "a_id long, name string")
    values = column_values({"a": a, "b": b, "none": a.limit(0)})
    got = {(r.table, r.column): (r.n_distinct, r.n_null, r.is_key) for r in column_profile(values).collect()}
    assert got == {("a", "id"): (3, 0, True), ("a", "name"): (2, 1, False), ("a", "empty"): (0, 3, False), ("b", "a_id"): (2, 1, False), ("b", "name"): (2, 1, False)}
    assert [tuple(r) for r in inclusions(values, Scratch(spark)).collect()] == [("b", "a_id", "a", "id", 2, pytest.approx(2 / 3))]


def test_spans():
    assert merged([], [5, 1, 100, 9], 10) == [(1, 9, 3), (100, 100, 1)]
    assert merged([(1, 9, 3), (25, 30, 2)], [17], 10) == [(1, 30, 6)]
    assert merged([(1, 9, 3)], [19], 10) == [(1, 9, 3), (19, 19, 1)]


def test_state_of_several_batches(spark, tmp_path):
    """Events out of order within the lateness give what a batch gives; later ones are dropped and counted; closed
    spans leave the state."""
    start, idle = datetime(2024, 1, 1), timedelta(hours=1)
    r = random.Random(3)
    batches = [[(r.randrange(6), start + timedelta(hours=3 * b, minutes=r.randrange(200))) for _ in range(30)] for b in range(6)]
    batches[4].append((0, start))  # long past the watermark
    batches[5] = [(7, start + timedelta(days=9))]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, t.isoformat()) for n, t in rows], "user_id int, at string").select("user_id", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import os
        import time

        for f in os.listdir(f"{tmp_path}/in"):
            if f.endswith(".parquet") and not f.startswith("batch"):
                os.rename(f"{tmp_path}/in/{f}", f"{tmp_path}/in/batch{i}.parquet")
                os.utime(f"{tmp_path}/in/batch{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)
    stream = spark.readStream.schema("user_id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = node_activity(stream, late="4 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((x.node, x.first_seen, x.last_seen, x.degree) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    want, high = [], start
    kept = []
    for rows in batches:
        kept += [(n, t) for n, t in rows if t >= high - timedelta(hours=4) or high == start]
        high = max(high, *(t for _, t in rows))
    assert len(kept) == sum(map(len, batches)) - 1
    for node in range(6):
        times = sorted(t for n, t in kept if n == node)
        spans = [[times[0]]]
        for t in times[1:]:
            spans.append([t]) if t - spans[-1][-1] >= idle else spans[-1].append(t)
        want += [(node, s[0], s[-1], len(s)) for s in spans]
    assert got == sorted(want)
    progress = [o for p in q.recentProgress for o in p["stateOperators"]]
    assert sum(o["numRowsDroppedByWatermark"] for o in progress) >= 1
    assert max(o["numRowsTotal"] for o in progress) > 1 and progress[-1]["numRowsTotal"] == 1  # only the last node is open
