"""Small cases worked out by hand, and invariants."""

import inspect
import math
import random

import pytest
from pyspark.sql import functions as F

from relmill.functions import features, metrics, scalars
from relmill.operators import aggregate, analytics, codecs, graph, ordered, sampling, tasks, validation
from relmill.plans.experiment import experiment, propagated
from relmill.schema import ForeignKey, RelationalDB, TaskType
from relmill.sources import tables


def graph_of(spark, edges, n=None):
    ids = sorted({x for e in edges for x in e[:2]}) if n is None else list(range(n))
    rows = [(a, b, float(w[0]) if w else 1.0) for a, b, *w in edges]
    return spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(rows, "src long, dst long, weight double")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_pagerank_sums_to_one_with_dangling_vertices(spark):
    v, e = graph_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    r = as_dict(analytics.pagerank(v, e, rounds=30))
    assert math.isclose(sum(r.values()), 1.0, rel_tol=1e-9) and r[0] > 0


def test_betweenness_of_a_path_and_a_diamond(spark):
    assert as_dict(analytics.betweenness(*graph_of(spark, [(0, 1), (1, 2), (2, 3)])))[1] == pytest.approx(4 / 6)
    two = as_dict(analytics.betweenness(*graph_of(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])))
    assert two[1] == two[2] == pytest.approx(1 / 6)


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_stays_on_tables(spark, monkeypatch, directed):
    r = random.Random(4)
    pairs = sorted({(r.randrange(9), r.randrange(9)) for _ in range(16)})
    near = {v: {b for a, b in pairs if a == v != b} | ({a for a, b in pairs if b == v != a} if not directed else set()) for v in range(10)}
    ways = {}  # all shortest paths of every pair of vertices, by extending them
    for s in near:
        level, seen = [[s]], {s}
        while level:
            level = [[*p, w] for p in level for w in near[p[-1]] if w not in seen]
            seen |= {p[-1] for p in level}
            for p in level:
                ways.setdefault((s, p[-1]), []).append(p)
    want = {v: sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in ways.values()) / (9 * 8) for v in near}
    v, e = graph_of(spark, pairs, 10)
    monkeypatch.setattr(type(e), "toPandas", None)
    assert as_dict(analytics.betweenness(v, e, directed, block_rows=60)) == pytest.approx(want)


def test_triangles_clustering_and_components(spark):
    v, e = graph_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6), (1, 0), (4, 4)], 7)
    assert as_dict(analytics.triangles(e)) == {0: 1, 1: 1, 2: 1}
    assert as_dict(analytics.clustering_coefficient(v, e))[2] == pytest.approx(1 / 3)
    assert as_dict(analytics.components(v, e)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}
    assert not analytics.is_connected(v, e).first()[0]
    assert analytics.graph_statistics(v, e).first()["components"] == 3


def test_component_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)]
    v, e = graph_of(spark, path)
    assert set(as_dict(analytics.components(v, e)).values()) == {0, 1000}


def test_paths(spark):
    v, e = graph_of(spark, [(0, 1, 5), (0, 2, 1), (2, 1, 1), (1, 3, 1)])
    start = v.where("id = 0")
    assert {r.id: r.distance for r in analytics.shortest_paths(e, start).collect()} == {0: 0, 1: 2, 2: 1, 3: 3}
    assert {r.id: r.level for r in analytics.bfs_levels(e, start).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert as_dict(analytics.closeness(v, e, start))[0] == pytest.approx(3 / 4)


def test_graph_loops_have_no_silent_cap(spark):
    for f in (analytics.bfs_levels, analytics.shortest_paths, analytics.greedy_colouring, analytics.cycle_vertices):
        most = inspect.signature(f).parameters.get("most")
        assert most is None or most.default is None
    v, e = graph_of(spark, [(0, 1), (1, 2), (2, 3)])
    assert {r.id for r in analytics.bfs_levels(e, v.where("id = 0"), most=2).collect()} == {0, 1, 2}
    assert analytics.cycle_vertices(e).count() == 0


def test_labels_colours_cycles(spark):
    v, e = graph_of(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    colours = as_dict(analytics.greedy_colouring(v, e))
    assert all(colours[r.src] != colours[r.dst] for r in e.collect())
    assert {0, 1, 2} <= {r.id for r in analytics.cycle_vertices(e).collect()}
    v, e = graph_of(spark, [(0, 1), (1, 2)])
    assert analytics.cycle_vertices(e).count() == 0
    assert set(as_dict(analytics.label_propagation(*graph_of(spark, [(0, 1)], 3), rounds=2))) == {0, 1, 2}


def test_empty_graph(spark):
    v, e = graph_of(spark, [], 0)
    for f in (analytics.pagerank, analytics.degree_centrality, analytics.components, analytics.clustering_coefficient, analytics.label_propagation):
        assert f(v, e).count() == 0


def test_metrics(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "score double, label int")
    assert metrics.roc_auc(s).first()[0] == 1.0
    assert metrics.roc_auc(s.withColumn("score", -F.col("score"))).first()[0] == 0.0
    assert metrics.roc_auc(s.withColumn("label", F.lit(1))).first()[0] == 0.5
    assert metrics.roc_auc(s.withColumn("score", F.lit(1.0))).first()[0] == 0.5
    assert metrics.average_precision(s).first()[0] == 1.0
    c = metrics.classification(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (0, 1)], "pred int, label int")).first()
    assert c.accuracy == 0.5
    assert metrics.classification(spark.createDataFrame([(1, 1), (1, 0), (0, 0), (1, 1)], "pred int, label int")).first()["precision"] == pytest.approx(2 / 3)
    assert metrics.regression(spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (3.0, 3.5)], "pred double, label double")).first().mse == 0.25
    r = metrics.ranking(spark.createDataFrame([(1, 0, 0.1, 0), (1, 1, 0.9, 1), (1, 2, 0.4, 0)], "query int, item int, score double, relevant int"), 3).first()
    assert r.map_at_k == r.mrr == r.ndcg_at_k == 1.0
    with pytest.raises(KeyError):
        metrics.evaluate(s, ["none"])
    with pytest.raises(ValueError):
        metrics.metric(metrics.roc_auc)


def test_codecs(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 2, 4, 7, 11])], "g int, i int, v long")
    assert [r.delta for r in codecs.delta_encode(d, "g", "i", "v").orderBy("i").collect()] == [1, 1, 2, 3, 4]
    r = spark.createDataFrame([(0, i, v) for i, v in enumerate([1, 1, 1, 2, 2, 3, None, None])], "g int, i int, v long")
    runs = codecs.run_length_encode(r, "g", "i", "v").orderBy("run")
    assert [(x.value, x.length) for x in runs.collect()] == [(1, 3), (2, 2), (3, 1), (None, 2)]
    assert codecs.run_length_decode(runs, "g").count() == 8
    q = codecs.quantise(d, "v", 2).orderBy("i").collect()
    assert [x.code for x in q] == [0, 0, 1, 2, 3] and codecs.quantise(d.withColumn("v", F.lit(3)), "v", 2).first().code == 0


def test_validation(spark):
    d = spark.createDataFrame([("", "50", "test@example.com", "{}", "2024-01-01T00:00:00Z"), ("null", "-1", "invalid-email", "{", "soon"), ("ok", "invalid", None, None, None)], "a string, b string, c string, d string, e string")
    rules = [("a", "not_null"), ("b", "range", 0, 100), ("c", "email"), ("d", "json"), ("e", "timestamp"), ("a", "unique"), ("short", "custom", F.length("a") < 3)]
    assert [r.violations for r in validation.validate(d, "t", rules).collect()] == [2, 2, 1, 1, 1, 0, 1]
    assert [r.violations for r in validation.validate(d.limit(0), "t", rules[:5]).collect()] == [0] * 5
    with pytest.raises(ValueError):
        validation.validate(d, "t", [("z", "not_null")])


def test_ordered(spark):
    d = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert ordered.row_index(d, ["x"]).where("x <> _row").count() == 0
    assert ordered.running_sums(d, ["x"], {"s": F.lit(1)}).where("s <> x + 1").count() == 0
    assert ordered.nearest_rank(d, "x", 0.5).first()[0] == 500
    assert ordered.nearest_rank(d.limit(0), "x", 0.5).count() == 0


def test_scalars(spark):
    row = spark.createDataFrame([("2024-01-02T10:00:00", " 1.5 ", "x", "")], "a string, b string, c string, d string")
    r = row.select(scalars.parse_time(F.col("a")).alias("a"), scalars.number_or_zero(F.col("b")).alias("b"), scalars.number_or_zero(F.col("c")).alias("c"), scalars.parse_time(F.col("d")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (1704153600.0, 1.5, 0.0, float("-inf"))
    assert scalars.learning_rate(0, 1.0, "warmup_cosine", 10, 5) == 0.2 and scalars.learning_rate(10, 1.0, "cosine", 10) == pytest.approx(0.0)
    assert TaskType.parse("Binary-Classification") is TaskType.BINARY


def test_messages(spark):
    _, e = graph_of(spark, [(0, 2, 1), (1, 2, 3)])
    x = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 2.0]), (2, [0.0, 0.0])], "node_id long, x array<double>")
    assert aggregate.scatter(e, x, "mean").first().x == [2.0, 1.0]
    assert aggregate.scatter(e, x, "sum", weight="weight").first().x == [10.0, 6.0]
    assert as_dict(aggregate.filled(aggregate.scatter(e, x), x, 2))[0] == [0.0, 0.0]
    a = aggregate.edge_softmax(e, "weight").agg(F.sum("alpha")).first()[0]
    assert a == pytest.approx(1.0)
    h = as_dict(aggregate.attention(e, x, [0.0, 0.0], [0.0, 0.0]))
    assert h[2] == pytest.approx([2.0, 1.0])
    s = as_dict(aggregate.sage_layer(e.withColumn("etype", F.lit(0)), x, [[1, 0], [0, 1]], {0: [[1, 0], [0, -1]]}))
    assert s[2] == [2.0, 0.0]
    assert aggregate.element_mean(spark.createDataFrame([([1.0, 2.0, 3.0],), ([2.0, 3.0, 4.0],)], "g array<double>"), "g").first().mean == [1.5, 2.5, 3.5]


def test_sampling(spark):
    _, e = graph_of(spark, [(i, 0) for i in range(1, 9)] + [(10 + i, i) for i in range(1, 9)])
    seeds = spark.createDataFrame([(0,)], "node_id long")
    s = sampling.neighbour_sample(e.withColumn("etime", F.col("src").cast("double")), seeds, [3, 2], 1)
    assert s.where("hop = 1").count() == 3 and s.where("hop = 2").count() == 3
    late = sampling.neighbour_sample(e.withColumn("etime", F.col("src").cast("double")), seeds, [2], seed_time=5.0, recent_first=True)
    assert {r.src for r in late.collect()} == {4, 5}
    w = sampling.random_walks(e, spark.createDataFrame([(7, 18)], "walk long, node long"), 5)
    assert [r.node for r in w.orderBy("step").collect()] == [18, 8, 0]
    with pytest.raises(ValueError):
        sampling.neighbour_sample(e, seeds, [])
    assert graph.duplicate_edges(e.unionByName(e), ["src", "dst"]).count() == 16


def test_tasks_windows_are_half_open(spark):
    c = spark.createDataFrame([(1,), (2,)], "k int")
    f = spark.sql("select * from values (1, timestamp_ntz'2024-01-01', 5.0), (1, timestamp_ntz'2024-01-11', 7.0), (2, timestamp_ntz'2024-01-12', 1.0) as t(c, at, a)")
    r = {x.k: (x.n_events, x.total, x.churn) for x in tasks.task_table(c, "k", f, "c", F.col("at"), ["2024-01-01"], 10, F.col("a")).collect()}
    assert r == {1: (1, 7.0, 0), 2: (0, 0.0, 1)}


def test_features(spark):
    d = spark.createDataFrame([(0, "b", 1.0), (1, "a", 1.0), (2, "b", 1.0), (3, None, 1.0)], "_row long, c string, x double")
    codes = {r._row: r.code for r in features.dictionary_encoded(d, "c", "_row", "code").collect()}
    assert codes == {0: 0, 1: 1, 2: 0, 3: 2}
    assert features.minmax(d, "x", "y").first().y == 0.0 and features.standardise(d, "x", "y").first().y == 0.0


def test_csv_round_trip_and_bad_key(spark, tmp_path):
    (tmp_path / "users.csv").write_text("id,age,country,when,churn\nu1,30,x,2024-01-01,1\nu2,old,y,,0\n")
    (tmp_path / "buys.csv").write_text("user,amount,when\nu2,5,10\nu1,6,20\n")
    role = lambda n, r: {"name": n, "role": r}
    import json

    schema = {"seed_table": "users", "tables": [
        {"name": "users", "file": "users.csv", "time_column": "when", "columns": [role("id", "PrimaryKey"), role("age", "Numerical"), role("country", "Categorical"), role("churn", "Label")]},
        {"name": "buys", "file": "buys.csv", "time_column": "when", "columns": [role("user", {"ForeignKey": "users"}), role("amount", "Numerical")]}]}
    (tmp_path / "schema.json").write_text(json.dumps(schema))
    db, spec, labels = tables.load_csv(spark, str(tmp_path))
    assert [r.age for r in db.tables["users"].orderBy("_row").collect()] == [30.0, 0.0]
    assert [r.user for r in db.tables["buys"].orderBy("_row").collect()] == [1, 0]
    db.check()
    tables.save_csv(db, spec, str(tmp_path / "copy"), labels)
    again, _, l2 = tables.load_csv(spark, str(tmp_path / "copy"))
    for n in ("users", "buys"):
        cols = sorted(set(db.tables[n].columns) & set(again.tables[n].columns))
        assert sorted(map(tuple, db.tables[n].select(cols).collect())) == sorted(map(tuple, again.tables[n].select(cols).collect()))
    assert {r.churn for r in l2.collect()} == {0.0, 1.0}
    (tmp_path / "buys.csv").write_text("user,amount,when\nu9,5,10\n")
    with pytest.raises(ValueError):
        tables.load_csv(spark, str(tmp_path))
    with pytest.raises(ValueError):
        RelationalDB("x", {"a": db.tables["users"]}, [ForeignKey("a", "nope", "a")], {"a": "_row"}).check()


def test_csv_parts_are_read_in_their_order(spark, tmp_path):
    import json

    role = lambda n, r: {"name": n, "role": r}
    (tmp_path / "users.csv").mkdir()
    for part, names in enumerate((["a"], ["b", "c", "d" * 50, "e"], ["f", "g"])):  # Spark reads the largest file first
        (tmp_path / "users.csv" / f"part-{part:05d}-x.csv").write_text("id,churn\n" + "".join(f"{n},{ord(n[0])}\n" for n in names))
    (tmp_path / "buys.csv").write_text("user\ng\na\nb\n")
    spec = [{"name": "users", "columns": [role("id", "PrimaryKey"), role("churn", "Label")]}, {"name": "buys", "columns": [role("user", {"ForeignKey": "users"})]}]
    (tmp_path / "schema.json").write_text(json.dumps({"seed_table": "users", "tables": spec}))
    db, _, labels = tables.load_csv(spark, str(tmp_path))
    assert [chr(int(r.churn)) for r in labels.orderBy("_row").collect()] == list("abcdefg")
    assert [r.user for r in db.tables["buys"].orderBy("_row").collect()] == [6, 0, 1]


def test_shop_graph_and_learning(spark):
    db, labels = tables.synthetic_shop(spark, users=200, items=40)
    nodes = graph.keyed_nodes(db).cache()
    edges = graph.edges(db, nodes).cache()
    assert nodes.count() == sum(d.count() for d in db.tables.values())
    assert edges.select("etype").distinct().count() == 4 and edges.count() == 4 * db.tables["transactions"].count()
    assert graph.visible(edges, 70.0).count() < edges.count()
    own = edges.where("etype = 1").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.max("etime").alias("last"))
    f = nodes.where("type_id = 0").join(own, "node_id", "left").select("node_id", F.array(F.coalesce("n", F.lit(0)) / 10.0, F.coalesce("last", F.lit(0.0)) / 1000).alias("x"))
    y = nodes.where("type_id = 0").join(labels.withColumnRenamed("_row", "row"), "row").select("node_id", F.col("churn").alias("label"))
    _, report = experiment(propagated(edges.limit(0), f, 1), y)
    assert report["valid"] > 0.6
    assert tables.row_counts(db.tables).count() == 3


def test_formats(spark, tmp_path):
    d = spark.range(10).withColumn("x", F.lit("a"))
    tables.save_parquet({"t": d}, str(tmp_path))
    assert tables.load_any(spark, f"{tmp_path}/t.parquet").count() == 10
    d.write.json(f"{tmp_path}/t.json"), d.write.option("header", True).csv(f"{tmp_path}/t.csv")
    assert tables.load_any(spark, f"{tmp_path}/t.json").count() == tables.load_any(spark, f"{tmp_path}/t.csv").count() == 10
    assert tables.describe({"t": d}).count() == 2
    with pytest.raises(ValueError):
        tables.load_any(spark, "t.xyz")
