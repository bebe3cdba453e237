"""Graph networks trained on tables: HeteroSAGE, RGCN with shared bases, GAT and RelGT, with a head on the seed nodes.

An epoch is one pass forwards and one backwards over the edges for each layer (``operators/backprop.py``). The driver holds
the weights, their AdamW moments and the log. Layers add their input to their output, as deep stacks need. RelGT's token is
one linear form of a node's features, which hold its type as one-hot, its time and its degrees (``node_features``).
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.functions import metrics
from relmill.functions.scalars import NEVER, learning_rate
from relmill.operators import backprop as bp
from relmill.operators import graph
from relmill.operators.backprop import node_map, sums, weighed
from relmill.operators.ordered import nearest_rank
from relmill.operators.tasks import hash_split
from relmill.plans.training import EarlyStop
from relmill.schema import RelationalDB, Role
from relmill.sources.tables import _text, load_csv, write_text
from relmill.staging import Scratch

KINDS = ("sage", "rgcn", "gat", "relgt")


@dataclass
class Network:
    """Weights by name. Where a row is more than there are inputs, the last is the bias."""

    kind: str
    layers: int
    relations: int
    weights: dict[str, np.ndarray]
    task: str = "binary"
    mean: float = 0.0
    scale: float = 1.0
    heads: int = 2
    log: list[dict] = field(default_factory=list)

    @classmethod
    def start(cls, kind: str, in_dim: int, hidden: int, layers: int, relations: int, bases: int = 2, heads: int = 2, centroids: int = 4, task: str = "binary", seed: int = 0) -> Network:
        """Uniform weights within one over the root of the inputs' number."""
        if kind not in KINDS:
            raise ValueError(f"unknown network: {kind}")
        if kind in ("gat", "relgt") and hidden % heads:
            raise ValueError(f"{hidden} dimensions do not divide into {heads} heads")
        shapes = {"input": (in_dim + 1, hidden), "head": (hidden + 1, 1)}
        for i in range(layers):
            shapes |= {
                "sage": {f"w{i}": ((relations + 1) * (hidden + 1), hidden)},
                "rgcn": {f"self{i}": (hidden + 1, hidden), f"bases{i}": (bases, hidden, hidden), f"mix{i}": (relations, bases)},
                "gat": {f"w{i}": (hidden + 1, hidden), f"a_dst{i}": (heads, hidden // heads), f"a_src{i}": (heads, hidden // heads)},
                "relgt": {f"{n}{i}": {"centroids": (centroids, hidden), "norm1": (2, hidden), "norm2": (2, hidden), "up": (hidden + 1, 2 * hidden), "down": (2 * hidden + 1, hidden)}.get(n, (hidden + 1, hidden)) for n in bp.BLOCK},
            }[kind]
        rng = np.random.default_rng(seed)
        bound = lambda n, s: 1 / math.sqrt({"input": in_dim}.get(n, bases if n.startswith("mix") else hidden))
        weights = {n: rng.uniform(-1, 1, s) * bound(n, s) for n, s in shapes.items()}
        for n in weights:
            if n.startswith("norm"):
                weights[n] = np.stack([np.ones(hidden), np.zeros(hidden)])
        return cls(kind, layers, relations, weights, task, heads=heads)

    @property
    def hidden(self) -> int:
        return self.weights["input"].shape[1]

    def block(self, i: int) -> dict[str, np.ndarray]:
        """The weights of layer i of a transformer, without its number."""
        return {n: self.weights[f"{n}{i}"] for n in bp.BLOCK}

    def mean_weights(self, i: int) -> np.ndarray:
        """SAGE's layout of layer i's weights: own, bias, one block a relation, the relations' biases."""
        if self.kind == "sage":
            return self.weights[f"w{i}"]
        blocks = np.einsum("rb,bij->rij", self.weights[f"mix{i}"], self.weights[f"bases{i}"])
        return np.concatenate([self.weights[f"self{i}"], blocks.reshape(-1, self.hidden), np.zeros((self.relations, self.hidden))])

    def save(self, spark: SparkSession, path: str) -> None:
        plain = {n: w.tolist() for n, w in self.weights.items()}
        write_text(spark, path, json.dumps({"kind": self.kind, "layers": self.layers, "relations": self.relations, "weights": plain, "task": self.task, "mean": self.mean, "scale": self.scale, "heads": self.heads, "log": self.log}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        raw = json.loads(_text(spark, path))
        return cls(**{**raw, "weights": {n: np.array(w, float) for n, w in raw["weights"].items()}})


class _Pass:
    """One pass over the graph; its stored tables go when it is over."""

    def __init__(self, net: Network, features: DataFrame, edges: DataFrame, by_target: DataFrame | None = None):
        self.net, self.features, self.edges, self.scratch, self.states = net, features, edges, Scratch(features.sparkSession, merge=True), []
        self.by_target = edges if by_target is None else by_target

    def forward(self) -> DataFrame:
        """(node_id, x) after the last layer."""
        net, w = self.net, self.net.weights
        start = w["input"]
        rectified = net.kind != "relgt"
        token = lambda x: np.maximum(x, 0) if rectified else x
        now = node_map(self.features.select("node_id", "x"), lambda a: {"x": token(a["x"] @ start[:-1] + start[-1])}, ["x"])
        now = self.scratch.store(now, "input")
        for i in range(net.layers):
            if net.kind == "gat":
                state = bp.attention_forward(self.edges, now, w[f"w{i}"], w[f"a_dst{i}"], w[f"a_src{i}"], self.scratch)
            elif net.kind == "relgt":
                state = bp.transformer_forward(self.edges, now, net.block(i), net.heads, self.scratch)
            else:
                state = bp.mean_forward(self.edges, now, net.mean_weights(i), net.relations)
            self.states.append(self.scratch.store(state, f"layer-{i}"))
            now = self.states[-1].select("node_id", "x")
        return now

    def backward(self, gradient: DataFrame) -> dict[str, np.ndarray]:
        """Gradients of all weights but the head's, from (node_id, g) after the last layer."""
        net, w, out = self.net, self.net.weights, {}
        for i in reversed(range(net.layers)):
            if net.kind == "gat":
                got, gradient = bp.attention_backward(self.edges, self.states[i], gradient, w[f"w{i}"], w[f"a_dst{i}"], w[f"a_src{i}"], self.scratch)
                out |= {f"{n}{i}": g for n, g in got.items()}
                continue
            if net.kind == "relgt":
                got, gradient = bp.transformer_backward(self.edges, self.states[i], gradient, net.block(i), net.heads, self.scratch)
                out |= {f"{n}{i}": g for n, g in got.items()}
                continue
            dw, gradient = bp.mean_backward(self.by_target, self.states[i], gradient, net.mean_weights(i), net.relations, self.scratch)
            if net.kind == "sage":
                out[f"w{i}"] = dw
                continue
            d, bases, mix = net.hidden, w[f"bases{i}"], w[f"mix{i}"]
            blocks = dw[d + 1 : d + 1 + net.relations * d].reshape(net.relations, d, d)
            out |= {f"self{i}": dw[: d + 1], f"bases{i}": np.einsum("rb,rij->bij", mix, blocks), f"mix{i}": np.einsum("bij,rij->rb", bases, blocks)}
        start, rectified = w["input"], net.kind != "relgt"

        def entry(a):
            g = a["g"] * (a["x"] @ start[:-1] + start[-1] > 0) if rectified else a["g"]
            return {"input": np.concatenate([a["x"].T @ g, g.sum(0)[None]])}

        out["input"] = sums(self.features.select("node_id", "x").join(gradient, "node_id"), entry)["input"].reshape(start.shape)
        return out

    def close(self) -> None:
        self.scratch.drop(self.scratch.root)


def _targets(labels: DataFrame, net: Network) -> DataFrame:
    """(node_id, y): arrays of the scaled label and, for training rows, one over their number."""
    n = labels.where("split = 'train'").count()
    if not n:
        raise ValueError("no rows to learn from")
    y = (F.col("label").cast("double") - net.mean) / net.scale
    return labels.select("node_id", F.array(y, F.when(F.col("split") == "train", 1.0 / n).otherwise(0.0)).alias("y"))


def dealt_edges(edges: DataFrame, kind: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Edges (src, dst, etype), weighed where the network takes means, stored in buckets by source and, for the way back of
    means, once more by target, so that no pass shuffles them."""
    plain = scratch.store(edges.select("src", "dst", "etype"), "plain-edges")
    rows, means = plain.count(), kind in ("sage", "rgcn")
    by_target = scratch.deal(weighed(plain, rows), "edges-by-target", rows, "dst") if means else None
    by_source = scratch.deal(by_target if means else plain, "edges", rows, "src")
    scratch.drop(plain)
    return by_source, by_target


def gradients(net: Network, features: DataFrame, edges: DataFrame, targets: DataFrame, by_target: DataFrame | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Loss over the training rows and the gradient of every weight. edges: see ``weighed``; by_target: the same rows, if
    they are stored by target too; targets: (node_id, y)."""
    run = _Pass(net, features, edges, by_target)
    head = net.weights["head"]

    def error(a):
        z = (a["x"] @ head[:-1] + head[-1])[:, 0]
        y, share = a["y"].T
        if net.task == "binary":
            return (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))) * share, (1 / (1 + np.exp(-z)) - y) * share
        return (z - y) ** 2 * share, 2 * (z - y) * share

    def top(a):
        loss, e = error(a)
        return {"loss": loss.sum(), "head": np.append(e @ a["x"], e.sum())}

    last = run.forward()
    both = run.scratch.store(last.join(targets, "node_id", "left").select("node_id", "x", F.coalesce("y", F.array(F.lit(0.0), F.lit(0.0))).alias("y")), "targets")
    got = sums(both, top)
    out = {"head": got["head"].reshape(head.shape)}
    out |= run.backward(node_map(both, lambda a: {"g": error(a)[1][:, None] * head[:-1, 0]}, ["g"]))
    run.close()
    return float(got["loss"][0]), out


def embed(net: Network, features: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, x) of all nodes after the last layer."""
    return _Pass(net, features, edges).forward()


def predict(net: Network, features: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, score): probabilities, or values in the labels' own unit."""
    run = _Pass(net, features, edges)
    head, mean, scale, binary = net.weights["head"], net.mean, net.scale, net.task == "binary"

    def score(a):
        z = a["x"] @ head[:-1] + head[-1]
        return {"s": 1 / (1 + np.exp(-z)) if binary else z * scale + mean}

    return node_map(run.forward(), score, ["s"]).select("node_id", F.col("s")[0].alias("score"))


def train(
    net: Network,
    features: DataFrame,
    edges: DataFrame,
    labels: DataFrame,
    epochs: int = 60,
    rate: float = 0.01,
    decay: float = 1e-5,
    schedule: str = "cosine",
    patience: int = 20,
    every: int = 1,
    each: Callable[[dict], None] | None = None,
    by_target: DataFrame | None = None,
) -> Network:
    """The network with the best validation value (ROC-AUC, or the negative mean absolute error).

    features: (node_id, x) of one length for every node; edges: (src, dst, etype), or both of ``dealt_edges``, which others may
    use as well; labels: (node_id, split, label).
    Labels of a regression are scaled by the training rows' mean and deviation. Validation runs each ``every`` epochs.
    """
    scratch = Scratch(features.sparkSession, merge=True)
    if by_target is None:
        edges, by_target = dealt_edges(edges, net.kind, scratch)
    features = scratch.store(features.select("node_id", F.col("x").cast("array<double>").alias("x")), "features")
    if net.task != "binary":
        m, s = labels.where("split = 'train'").agg(F.avg("label"), F.stddev_pop("label")).first()
        net.mean, net.scale = float(m or 0.0), max(float(s or 0.0), 1e-6)
    targets = scratch.store(_targets(labels, net), "targets")
    valid = scratch.store(labels.where("split = 'valid'").select("node_id", F.col("label").cast("double").alias("label")), "valid")
    m = {n: np.zeros_like(w) for n, w in net.weights.items()}
    v = {n: np.zeros_like(w) for n, w in net.weights.items()}
    stop, best = EarlyStop(patience), dict(net.weights)
    for epoch in range(epochs):
        loss, grads = gradients(net, features, edges, targets, by_target)
        if not math.isfinite(loss):
            raise ValueError(f"epoch {epoch}: the loss is {loss}")
        step = learning_rate(epoch, rate, schedule, epochs, 0)
        for n, g in grads.items():  # AdamW (Loshchilov and Hutter, 2019)
            m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
            move = m[n] / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(v[n] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
            net.weights[n] = net.weights[n] * (1 - step * decay) - step * move
        entry = {"epoch": epoch, "loss": loss, "rate": step, "gradient": float(np.sqrt(sum((g * g).sum() for g in grads.values())))}
        if (epoch + 1) % every == 0 or epoch + 1 == epochs:
            scored = scratch.store(predict(net, features, edges).join(valid, "node_id"), "scored")
            entry["valid"] = metrics.roc_auc(scored).first()[0] if net.task == "binary" else -metrics.regression(scored, pred="score").first()["mae"]
            scratch.drop(scored)
        net.log.append(entry)
        if each:
            each(entry)
        if "valid" in entry:
            if stop.better(entry["valid"] if entry["valid"] is not None else -math.inf):
                best = dict(net.weights)
            elif stop.over:
                break
    net.weights = best
    return net


def node_features(db: RelationalDB, nodes: DataFrame, columns: dict[str, list[str]], edges: DataFrame | None = None, relations: int = 0, at: float = math.inf) -> DataFrame:
    """(node_id, x) of every node of a database: its table as one-hot, the named numeric columns less their mean and
    over their deviation, zero for other tables, nulls and values that are not finite, and, with edges, the logarithm of one
    plus the in-degree by relation. Rows newer than ``at`` show their table only, and the means do not see them."""
    names = list(db.tables)
    slots = [(n, c) for n in names for c in columns.get(n, [])]
    out = None
    for n in names:
        df = db.tables[n]
        own = [c for t, c in slots if t == n]
        seen = F.col(db.times[n]) <= at if n in db.times and at < math.inf else F.lit(True)
        value = {c: F.when(seen & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < math.inf), F.col(c).cast("double")) for c in own}
        stats = df.agg(*[f(value[c]) for c in own for f in (F.avg, F.stddev_pop)]).first() if own else ()
        scaled = {c: F.coalesce((value[c] - F.lit(stats[2 * i] or 0.0)) / F.lit(stats[2 * i + 1] or 1.0), F.lit(0.0)) for i, c in enumerate(own)}
        x = F.array(*[F.lit(float(t == n)) for t in names], *[scaled[c] if t == n else F.lit(0.0) for t, c in slots])
        rows = df.select(F.col(db.keys[n]).cast("string").alias("key"), x.alias("x")).join(nodes.where(F.col("table") == n).select("key", "node_id"), "key").select("node_id", "x")
        out = rows if out is None else out.unionByName(rows)
    if edges is None:
        return out
    degree = edges.groupBy(F.col("dst").alias("node_id")).agg(F.array(*[F.log1p(F.count_if(F.col("etype") == r)) for r in range(relations)]).alias("d"))
    return out.join(degree, "node_id", "left").select("node_id", F.concat("x", F.coalesce("d", F.array_repeat(F.lit(0.0), relations))).alias("x"))


def run_experiment(
    db: RelationalDB,
    labels: DataFrame,
    seed_table: str,
    label: str,
    at: float,
    columns: dict[str, list[str]],
    kind: str = "sage",
    task: str = "binary",
    hidden: int = 16,
    layers: int = 2,
    epochs: int = 30,
    rate: float = 0.05,
    every: int = 5,
    seed: int = 0,
    **options,
) -> tuple[Network, dict]:
    """From a database to a trained network and its report, in one call.

    labels: (_row, label) of the seed table's rows. Edges are those known at ``at``, and no feature is read from a row that
    is newer. Rows are split 60:20:20 by a hash of the row and ``seed``. The report holds the sizes of the graph, the log, the
    measures of the validation and test rows (loss aside) and the seconds.
    """
    began = time.perf_counter()
    scratch = Scratch(labels.sparkSession)
    nodes = scratch.store(graph.keyed_nodes(db), "nodes")
    edges = scratch.store(graph.visible(graph.edges(db, nodes), at), "edges")
    relations = 2 * len(db.foreign_keys)
    x = scratch.store(node_features(db, nodes, columns, edges, relations, at), "features")
    rows = nodes.where(F.col("table") == seed_table).select("node_id", F.col("row").alias("_row")).join(labels.select("_row", F.col(label).cast("double").alias("label")), "_row")
    rows = scratch.store(hash_split(rows, "node_id", seed).select("node_id", "split", "label"), "labels")
    net = Network.start(kind, len(x.first().x), hidden, layers, relations, task=task, seed=seed)
    dealt, by_target = dealt_edges(edges, kind, scratch)
    net = train(net, x, dealt, rows, epochs, rate, every=every, by_target=by_target, **options)
    scored = scratch.store(predict(net, x, dealt).join(rows, "node_id"), "scores")
    report = {"kind": kind, "task": task, "nodes": x.count(), "edges": edges.count(), "relations": relations, "epochs": len(net.log), "log": net.log}
    for split in ("valid", "test"):
        held = scored.where(F.col("split") == split)
        if task == "binary":
            report[split] = {"auroc": metrics.roc_auc(held).first()[0], "accuracy": held.agg(F.avg(((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]}
        else:
            report[split] = {k: v for k, v in metrics.regression(held, pred="score").first().asDict().items()}
    return net, report | {"seconds": time.perf_counter() - began}


def run_folder(spark: SparkSession, folder: str, label: str, quantile: float = 0.7, **options) -> tuple[Network, dict]:
    """The same for a folder of CSV files with schema.json: the seed time is a quantile of all row times, features are
    the numeric columns and times."""
    db, spec, labels = load_csv(spark, folder)
    times = None
    for name, df in db.tables.items():
        own = df.where(F.col("_time") > NEVER).select("_time")
        times = own if times is None else times.unionByName(own)
    at = nearest_rank(times, "_time", quantile).first()
    columns = {t.name: [*t.columns(Role.NUMERICAL), *([] if t.time_column is None else ["_time"])] for t in spec.tables}
    return run_experiment(db, labels, spec.seed_table, label, at[0] if at else math.inf, columns, **options)
