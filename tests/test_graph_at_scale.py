"""Strong components, colouring, walks, sketches and the quantiser against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relmill.operators import analytics, colouring, cycles, quantiser, sketches, walks
from relmill.plans.catalog import order_edges
from relmill.staging import Scratch


def closure(n, pairs):
    out = {v: {v} for v in range(n)}
    step = {v: {b for a, b in pairs if a == v} for v in range(n)}
    for v in range(n):
        todo = [v]
        while todo:
            for b in step[todo.pop()]:
                if b not in out[v]:
                    out[v].add(b)
                    todo.append(b)
    return out


@pytest.mark.parametrize("kind", ["sparse", "dense", "rings", "nested"])
def test_strong_components(spark, kind):
    r = random.Random(kind)
    n = 60
    pairs = {(r.randrange(n), r.randrange(n)) for _ in range({"sparse": 55, "dense": 130, "rings": 5, "nested": 10}[kind])}
    if kind == "rings":
        pairs |= {(i, i // 10 * 10 + (i + 1) % 10) for i in range(40)}
    if kind == "nested":  # rings whose parts are chains of their own
        pairs |= {(i, i + 1) for i in range(30)} | {(30, 0), (12, 5), (20, 18), (40, 40)}
    got = {x.id: (x.component, x["size"], x.on_cycle) for x in cycles.strong_components(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(sorted(pairs) + [(None, 3), (3, None)], "src long, dst long")).collect()}
    reach = closure(n, pairs)
    for v in range(n):
        own = {b for b in reach[v] if v in reach[b]}
        assert got[v] == (min(own), len(own), len(own) > 1 or (v, v) in pairs), v


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    rounds = Counter()
    trimmed = cycles._trimmed
    monkeypatch.setattr(cycles, "_trimmed", lambda *a: (rounds.update(["trim"]), trimmed(*a))[1])
    chain = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    out = cycles.strong_components(spark.range(n), chain.union(spark.createDataFrame([(20_000, 20_001), (20_001, 20_000)], "src long, dst long")))
    assert out.where("on_cycle").count() == 2 and out.count() == n + 2
    assert rounds["trim"] < 6


def test_no_graph(spark):
    none, two = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1,), (2,), (2,)], "id long")
    assert sorted(map(tuple, cycles.strong_components(two, none).collect())) == [(1, 1, 1, False), (2, 2, 1, False)]
    assert sorted(map(tuple, colouring.priority_colouring(two, none).collect())) == [(1, 0), (2, 0)]
    assert colouring.priority_colouring(two.limit(0), none).count() == 0
    assert sorted(map(tuple, sketches.neighbourhoods(two, none).collect())) == [(1, 0, 1), (2, 0, 1)]


def test_colouring_of_a_path(spark, monkeypatch):
    """Proper, at most three colours, in few rounds."""
    rounds = Counter()
    store = Scratch.store
    monkeypatch.setattr(Scratch, "store", lambda self, df, name, *a: (rounds.update([name]), store(self, df, name, *a))[1])
    n = 10_000
    path = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    out = {x.id: x.colour for x in colouring.priority_colouring(spark.range(n), path).collect()}
    assert len(out) == n and all(out[i] != out[i + 1] for i in range(n - 1)) and max(out.values()) <= 2
    assert rounds["coloured"] < 25


def test_walks_follow_their_weights(spark):
    """Shares of the moves 0 -> 1 -> ? of many walks against the exact ones; a hub costs a row a walk."""
    pairs = [(0, 1), (1, 0), (1, 2), (0, 2), (2, 0), (2, 1), (1, 3), (3, 1), (1, 4), (4, 1), (9, 9)]
    e = spark.createDataFrame(pairs + pairs[:3] + [(None, 1)], "src long, dst long")
    starts = spark.range(6_000).selectExpr("id as walk", "0 as node").union(spark.createDataFrame([(-1, 77), (-2, 9)], "walk long, node int"))
    rows = walks.node2vec_walks(e, starts, 2, p=0.5, q=4.0, seed=3).collect()
    path = {}
    for x in sorted(rows, key=lambda x: x.step):
        path.setdefault(x.walk, []).append(x.node)
    assert path.pop(-1) == [77] and path.pop(-2) == [9, 9, 9]
    first = Counter(p[1] for p in path.values())
    assert abs(first[1] / 6_000 - 0.5) < 0.03
    after = Counter(p[2] for p in path.values() if p[1] == 1)
    weight = {0: 2.0, 2: 1.0, 3: 0.25, 4: 0.25}
    total = sum(after.values())
    chi2 = sum((after[k] - total * w / 3.5) ** 2 / (total * w / 3.5) for k, w in weight.items())
    assert chi2 < 16.3  # 0.1 % of three degrees of freedom
    again = walks.node2vec_walks(e, starts, 2, p=0.5, q=4.0, seed=3).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    with pytest.raises(ValueError, match="positive"):
        walks.node2vec_walks(e, starts, 0)


def test_sketches_on_a_giant_component(spark):
    r = random.Random(5)
    n = 3_000
    pairs = [(i, r.randrange(n)) for i in range(n) for _ in range(3)]
    v, e = spark.range(n), spark.createDataFrame(pairs, "src long, dst long")
    got = {x.id: x for x in sketches.sketched_closeness(v, e, precision=12).collect()}
    step = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)
    for start in range(0, n, 300):
        dist, now = {start: 0}, [start]
        while now:
            now = [b for a in now for b in step[a] if b not in dist and dist.setdefault(b, dist[a] + 1)]
        reach, total = len(dist) - 1, sum(dist.values())
        assert abs(got[start].reached / reach - 1) < 0.06
        assert abs(got[start].closeness / (reach / total) - 1) < 0.06
    small = {x.id: x for x in sketches.sketched_closeness(spark.range(6), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3), (5, 77)], "src long, dst long")).collect()}
    assert (small[0].reached, small[0].distance, small[0].harmonic) == (3, 4, 2.5) and small[5].reached == 0
    exact = {x.id: x.closeness for x in analytics.closeness(spark.range(6), spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3)], "src long, dst long")).collect()}
    both = sketches.sketched_closeness(spark.range(6), spark.createDataFrame([p for a, b in [(0, 1), (1, 2), (2, 3), (0, 3)] for p in ((a, b), (b, a))], "src long, dst long"))
    assert {x.id: pytest.approx(x.closeness) for x in both.collect()} == exact


def test_quantiser(spark):
    r = random.Random(1)
    heads = [[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]]
    rows = [(i, [c + r.gauss(0, 0.5) for c in heads[i % 3]]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, x array<double>")
    book = quantiser.Codebook.start([[1.0, 1.0], [2.0, 1.0], [500.0, 500.0]], decay=0.5)
    errors = [book.update(v, dead=0.6) for _ in range(8)]  # the third code wins nothing and starts again
    assert errors[-1] < 0.1 * errors[0]
    assert all(min(math.dist(c, h) for c in book.codes) < 0.5 for h in heads)
    again = quantiser.Codebook.of(book.table(spark), decay=0.5)
    assert again == book
    near = {x.id: x.code for x in again.assign(v).collect()}
    assert len(set(near.values())) == 3 and all(near[i] == near[i % 3] for i in range(300))
    assert book.update(v.limit(0)) == 0.0 and again == book


def test_loops_send_no_tables_by_way_of_the_driver(spark, monkeypatch):
    from relmill.operators import communities, paths

    plans, store = [], Scratch.store

    def watched(self, df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(self, df, *args, **kw)

    pairs = [(i, i + 1, 1.0) for i in range(6)] + [(5, 0, 1.0), (8, 9, 2.0)]
    v = spark.createDataFrame([(i,) for i in range(10)], "id long")
    e = spark.createDataFrame(pairs, "src long, dst long, weight double")
    monkeypatch.setattr(Scratch, "store", watched)
    assert paths.all_pairs(v, e).where("source = 0").count() == 7
    paths.paths(analytics.bfs_levels(e, v))
    analytics.betweenness(v, e)
    communities.louvain(v, e)
    cycles.strong_components(v, e)
    assert sum("SortMergeJoin" in p for p in plans) > 20
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_order_edges_are_dealt_by_rows(spark, tmp_path):
    """Columns of ids take few bytes, and parts sized by bytes would hold millions of rows."""
    n = 4_000_000
    line = spark.range(n).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 20_000).alias("l_partkey"), F.lit(1.0).alias("l_quantity"))
    order = spark.range(n // 4).select(F.col("id").alias("o_orderkey"), (F.col("id") % 50_000).alias("o_custkey"), F.lit("1999-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    order.write.parquet(f"{tmp_path}/orders.parquet")
    parts = [r["n"] for r in order_edges(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == n and max(parts) < 700_000
