"""Gradients against finite differences; every network learns the shop's labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relmill.functions import metrics
from relmill.operators import graph
from relmill.operators.tasks import hash_split
from relmill.plans import gnn
from relmill.sources.tables import synthetic_shop
from relmill.staging import Scratch


def small(spark, seed=0):
    r = np.random.default_rng(seed)
    x = [(i, [float(v) for v in r.normal(size=3)]) for i in range(9)]
    pairs = sorted({(int(a), int(b), int(t)) for a, b, t in zip(r.integers(0, 9, 30), r.integers(0, 8, 30), r.integers(0, 2, 30), strict=True)})  # node 8 gets nothing
    labels = [(i, "train" if i < 5 else "valid", float(i % 2)) for i in range(7)]
    return spark.createDataFrame(x, "node_id long, x array<double>"), spark.createDataFrame(pairs, "src long, dst long, etype int"), spark.createDataFrame(labels, "node_id long, split string, label double"), np.array([v for _, v in x]), pairs, labels


def plain_block(w, heads, h, pairs):
    affine = lambda a, m: a @ m[:-1] + m[-1]
    soft = lambda s: np.exp(s) / np.exp(s).sum()
    norm = lambda a, m: np.array([(r - r.mean()) / np.sqrt(r.var() + 1e-5) for r in a]) * m[0] + m[1]
    q, k, v, gq, gk, gv = (affine(w["centroids"] if n in ("gk", "gv") else h, w[n]) for n in ("q", "k", "v", "gq", "gk", "gv"))
    width = h.shape[1] // heads
    local, far = np.zeros_like(h), np.zeros_like(h)
    for a in range(heads):
        at = slice(a * width, (a + 1) * width)
        for j in range(len(h)):
            far[j, at] = soft(gk[:, at] @ gq[j, at] / np.sqrt(width)) @ gv[:, at]
            src = [x for x, y, _ in pairs if y == j]
            if src:
                local[j, at] = soft(k[src][:, at] @ q[j, at] / np.sqrt(width)) @ v[src][:, at]
    h = norm(h + affine(local, w["o"]) + affine(far, w["go"]), w["norm1"])
    return norm(h + affine(np.maximum(affine(h, w["up"]), 0), w["down"]), w["norm2"])


def plain_loss(net, x, pairs, labels):
    """The same network on dense arrays."""
    w, n = net.weights, len(x)
    affine = lambda a, m: a @ m[:-1] + m[-1]
    h = affine(x, w["input"])
    h = h if net.kind == "relgt" else np.maximum(h, 0)
    for i in range(net.layers):
        if net.kind == "relgt":
            h = plain_block(net.block(i), net.heads, h, pairs)
            continue
        if net.kind == "gat":
            p = affine(h, w[f"w{i}"])
            heads, width = w[f"a_dst{i}"].shape
            out = np.zeros_like(h)
            for k in range(heads):
                part = p[:, k * width : (k + 1) * width]
                left, right = part @ w[f"a_dst{i}"][k], part @ w[f"a_src{i}"][k]
                for j in range(n):
                    src = [a for a, b, _ in pairs if b == j]
                    if src:
                        s = left[j] + right[src]
                        s = np.exp(np.where(s > 0, s, 0.2 * s))
                        out[j, k * width : (k + 1) * width] = (s / s.sum()) @ part[src]
        else:
            m = net.mean_weights(i)
            d, own, rest = h.shape[1], m[: h.shape[1]], m[h.shape[1] + 1 :]
            out = h @ own + m[d]
            for r in range(net.relations):
                for j in range(n):
                    src = [a for a, b, t in pairs if b == j and t == r]
                    if src:
                        out[j] += h[src].mean(0) @ rest[r * d : (r + 1) * d] + rest[net.relations * d + r]
        h = np.maximum(out, 0) + h
    z = affine(h, w["head"])[:, 0]
    at = [i for i, s, _ in labels if s == "train"]
    y = (np.array([v for _, s, v in labels if s == "train"]) - net.mean) / net.scale
    return (np.maximum(z[at], 0) - z[at] * y + np.log1p(np.exp(-np.abs(z[at])))).mean() if net.task == "binary" else ((z[at] - y) ** 2).mean()


@pytest.mark.parametrize(("kind", "task"), [("sage", "binary"), ("rgcn", "regression"), ("gat", "binary"), ("relgt", "regression")])
def test_every_gradient(spark, kind, task):
    x, e, labels, *plain = small(spark)
    net = gnn.Network.start(kind, 3, 4, 2, 2, task=task, seed=3)
    loss, grads = gnn.gradients(net, x, gnn.weighed(e), gnn._targets(labels, net))
    assert loss == pytest.approx(plain_loss(net, *plain), rel=1e-12)
    assert set(grads) == set(net.weights)
    for name, w in net.weights.items():
        for at in np.ndindex(w.shape):
            old, eps = w[at], 1e-6
            w[at] = old + eps
            up = plain_loss(net, *plain)
            w[at] = old - eps
            down = plain_loss(net, *plain)
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-6), (name, at)


@pytest.fixture(scope="module")
def shop(spark):
    from relmill.staging import Scratch

    db, labels = synthetic_shop(spark, users=300, items=80, seed=1)
    scratch = Scratch(spark)
    nodes = scratch.store(graph.keyed_nodes(db), "nodes")
    edges = scratch.store(graph.edges(db, nodes), "edges")
    x = scratch.store(gnn.node_features(db, nodes, {"users": ["age", "_time"], "items": ["price"], "transactions": ["amount", "_time"]}, edges, 4), "features")
    users = nodes.where("table = 'users'").select("node_id", F.col("row").alias("_row"))
    labels = hash_split(labels.join(users, "_row"), "node_id", 7)
    return x, edges, scratch.store(labels.select("node_id", "split", "churn", "ltv"), "labels")


@pytest.mark.parametrize(("kind", "layers"), [("sage", 2), ("rgcn", 1), ("gat", 1), ("relgt", 1)])
def test_networks_learn_churn(spark, shop, kind, layers):
    x, edges, labels = shop
    dim = len(x.first().x)
    net = gnn.Network.start(kind, dim, 8, layers, 4, seed=1)
    rows = labels.withColumnRenamed("churn", "label")
    net = gnn.train(net, x, edges, rows, epochs=12, rate=0.05, every=6)
    losses = [e["loss"] for e in net.log]
    assert losses[-1] < losses[0]
    test = gnn.predict(net, x, gnn.weighed(edges)).join(rows.where("split <> 'train'"), "node_id")
    assert metrics.roc_auc(test).first()[0] > 0.6


def test_regression_and_reload(spark, shop, tmp_path):
    x, edges, labels = shop
    rows = labels.withColumnRenamed("ltv", "label")
    net = gnn.train(gnn.Network.start("sage", len(x.first().x), 8, 1, 4, task="regression", seed=2), x, edges, rows, epochs=8, rate=0.05, every=4)
    assert net.log[-1]["loss"] < net.log[0]["loss"]
    net.save(spark, f"{tmp_path}/net.json")
    again = gnn.Network.load(spark, f"{tmp_path}/net.json")
    one, two = (dict(gnn.predict(n, x, gnn.weighed(edges)).collect()) for n in (net, again))
    assert one == pytest.approx(two)
    held = rows.where("split = 'test'").join(gnn.predict(net, x, gnn.weighed(edges)), "node_id")
    mae, spread = held.agg(F.avg(F.abs(F.col("score") - F.col("label"))), F.stddev_pop("label")).first()
    assert mae < spread


def test_bad_networks(spark):
    with pytest.raises(ValueError, match="unknown network"):
        gnn.Network.start("mlp", 2, 4, 1, 1)
    with pytest.raises(ValueError, match="heads"):
        gnn.Network.start("gat", 2, 5, 1, 1)
    x, e, labels, *_ = small(spark)
    with pytest.raises(ValueError, match="no rows"):
        gnn.train(gnn.Network.start("sage", 3, 4, 1, 2), x, e, labels.where("split = 'valid'"), epochs=1)


def test_one_call_from_a_folder(spark, tmp_path):
    """CSV files with a schema to a report; rows after the seed time change nothing that is learned from."""
    from relmill.schema import DatabaseSpec, Role, TableSpec
    from relmill.sources.tables import save_csv

    db, labels = synthetic_shop(spark, users=120, items=30, seed=5)
    fk = {"user_id": Role.FOREIGN_KEY, "item_id": Role.FOREIGN_KEY}
    spec = DatabaseSpec(
        [
            TableSpec("users", {"age": Role.NUMERICAL}), TableSpec("items", {"price": Role.NUMERICAL}),
            TableSpec("transactions", {"amount": Role.NUMERICAL, **fk}, {"user_id": "users", "item_id": "items"}),
        ], "users"
    )
    save_csv(db, spec, str(tmp_path / "shop"), labels)
    net, report = gnn.run_folder(spark, str(tmp_path / "shop"), "churn", hidden=4, layers=1, epochs=6, every=3)
    assert report["relations"] == 4 and report["nodes"] == sum(df.count() for df in db.tables.values()) and report["epochs"] == 6
    assert report["log"][-1]["loss"] < report["log"][0]["loss"] and 0 <= report["test"]["auroc"] <= 1 and 0 <= report["valid"]["accuracy"] <= 1


def test_features_know_nothing_newer(spark):
    from relmill.schema import RelationalDB

    def features(late):
        df = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 10.0), (2, late, 11.0), (3, float("nan"), 1.0)], "k long, v double, at double")
        db = RelationalDB("x", {"a": df}, [], {"a": "k"}, {"a": "at"})
        return {r.node_id: r.x for r in gnn.node_features(db, graph.keyed_nodes(db), {"a": ["v"]}, at=10.0).collect()}

    assert features(7.0) == features(-1e9) == {0: [1.0, -1.0], 1: [1.0, 1.0], 2: [1.0, 0.0], 3: [1.0, 0.0]}


def test_passes_do_not_shuffle_dealt_edges(spark):
    """Edges are stored by source and by target once; only the nodes are shuffled in a join with them."""
    scratch = Scratch(spark, merge=True)
    rows = [(1, 10, 0), (2, 10, 0), (2, 11, 0), (10, 1, 1), (10, 2, 1), (11, 2, 1)]
    by_source, by_target = gnn.dealt_edges(spark.createDataFrame(rows, "src long, dst long, etype int"), "sage", scratch)
    want = sorted((*r, 1 / sum(x[1:] == r[1:] for x in rows)) for r in rows)
    nodes = spark.range(100).withColumn("x", F.rand(1))
    for df, key in ((by_source, "src"), (by_target, "dst")):
        assert sorted(map(tuple, df.select("src", "dst", "etype", "w").collect())) == want
        plan = df.join(nodes.withColumnRenamed("id", key), key)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    scratch.drop(scratch.root)
    assert not [x for x in spark.catalog.listTables() if x.name in scratch.tables.values() or x.name.startswith("relmill_")]
    assert gnn.dealt_edges(spark.createDataFrame(rows, "src long, dst long, etype int"), "gat", scratch)[1] is None
