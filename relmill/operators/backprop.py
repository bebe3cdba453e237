"""Message-passing layers forwards and backwards, as joins and grouped sums over edges.

A layer forwards sends vectors along the edges and adds them up per target; backwards the same join and the same sums
send gradients along the reversed edges. What happens inside one node is a product with a small matrix, done on Arrow
batches. Weight gradients are outer products added up inside each task first, so a task sends one row per weight, however
many nodes it has read. Nothing but the weights and their gradients reaches the driver. Sums over edges are partial
before the shuffle, so a hub costs one row per task.

Node tables are (node_id, arrays of doubles), edges (src, dst, etype, w).
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.staging import Scratch, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOPE = 0.2
Arrays = dict[str, np.ndarray]


def _inputs(batch) -> Arrays:
    return {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.schema.names if c != "node_id"}


def _lists(x: np.ndarray):
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32), pa.array(x.ravel())) if x.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))


def node_map(nodes: DataFrame, step: Callable[[Arrays], Arrays], out: list[str]) -> DataFrame:
    """(node_id, out): a function of the arrays of a batch of nodes, a row each."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                done = step(_inputs(b))
                yield pa.RecordBatch.from_arrays([b.column("node_id"), *[_lists(done[c]) for c in out]], ["node_id", *out])

    return nodes.mapInArrow(run, ", ".join(["node_id long", *[f"{c} array<double>" for c in out]]))


def sums(nodes: DataFrame, step: Callable[[Arrays], Arrays]) -> Arrays:
    """Sums over all nodes of what a function gives for a batch, flat, by name. They are as large as the weights."""

    def run(batches):
        total: Arrays = {}
        for b in batches:
            if b.num_rows:
                for name, v in step(_inputs(b)).items():
                    total[name] = total.get(name, 0) + np.asarray(v, float).ravel()
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["name", "pos", "v"])

    rows = nodes.mapInArrow(run, "name string, pos int, v double").groupBy("name", "pos").agg(F.sum("v").alias("v")).collect()
    size = {n: 1 + max(r.pos for r in rows if r.name == n) for n in {r.name for r in rows}}
    out = {n: np.zeros(k) for n, k in size.items()}
    for r in rows:
        out[r.name][r.pos] = r.v
    return out


def weighed(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(src, dst, etype, w): w is one over the number of edges of the relation into the target, so that sums are means.
    With the number of ``rows`` the result is dealt by target."""
    n = edges.groupBy("dst", "etype").agg((1.0 / F.count("*")).alias("w")).groupBy("dst").agg(F.map_from_entries(F.collect_list(F.struct("etype", "w"))).alias("ws"))  # an entry per relation
    own = edges.select("src", "dst", "etype")
    return (own if rows is None else spread(own, rows, "dst")).join(n, "dst").select("src", "dst", "etype", F.col("ws")[F.col("etype")].alias("w"))


def _sum_of(parts: list[Column]) -> Column:
    return F.array(*[F.sum(p) for p in parts])


def _zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def _add(a: str, b: str, n: int) -> Column:
    return F.zip_with(a, F.coalesce(b, _zeros(n)), lambda x, y: x + y)


# ------------------------------------------------------------------------------------------------
# Means per relation: x' = relu(W [x, 1, mean_1 x .. mean_R x, has_1 .. has_R]) + x.


def gathered(edges: DataFrame, nodes: DataFrame, dim: int, relations: int) -> DataFrame:
    """(node_id, m): each node's vector, a one, the mean over its in-edges of each relation, zeros where there is none,
    and whether there is one. Sources without a vector send nothing."""
    x = F.col("x")
    sent = edges.join(nodes.select(F.col("node_id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node_id"), (F.col("etype") + 1).alias("slot")).agg(_sum_of([F.col("w") * x[i] for i in range(dim)]).alias("v"))
    parts = nodes.select("node_id", F.lit(0).alias("slot"), F.col("x").alias("v")).unionByName(sent)
    one = parts.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("p"))  # a part per relation
    part = lambda k: F.try_element_at("p", F.lit(k))
    means = [F.coalesce(part(r + 1), _zeros(dim)) for r in range(relations)]
    has = F.array(*[part(r + 1).isNotNull().cast("double") for r in range(relations)])
    return one.where(part(0).isNotNull()).select("node_id", F.concat(part(0), F.array(F.lit(1.0)), *means, has).alias("m"))


def mean_forward(edges: DataFrame, nodes: DataFrame, w: np.ndarray, relations: int) -> DataFrame:
    """(node_id, m, x)."""
    dim = w.shape[1]
    return node_map(gathered(edges, nodes, dim, relations), lambda a: {"m": a["m"], "x": np.maximum(a["m"] @ w, 0) + a["m"][:, :dim]}, ["m", "x"])


def mean_backward(edges: DataFrame, state: DataFrame, gradient: DataFrame, w: np.ndarray, relations: int, scratch: Scratch) -> tuple[np.ndarray, DataFrame]:
    """Gradient of w, and (node_id, g) of the layer's input, from (node_id, g) of its output."""
    dim = w.shape[1]
    both = scratch.store(state.select("node_id", "m").join(gradient, "node_id"), "mean-backward")
    local = lambda a: a["g"] * (a["m"] @ w > 0)
    dw = sums(both, lambda a: {"w": a["m"].T @ local(a)})["w"].reshape(w.shape)
    own, sent = w[:dim].T, w[dim + 1 : dim + 1 + relations * dim].T
    back = node_map(both, lambda a: {"g": a["g"] + local(a) @ own, "s": local(a) @ sent}, ["g", "s"])
    part = lambda i: F.col("w") * F.get("s", F.col("etype") * dim + i)
    got = edges.join(back.select(F.col("node_id").alias("dst"), "s"), "dst").groupBy(F.col("src").alias("node_id")).agg(_sum_of([part(i) for i in range(dim)]).alias("b"))
    return dw, back.join(got, "node_id", "left").select("node_id", _add("g", "b", dim).alias("g"))


# ------------------------------------------------------------------------------------------------
# Attention: p = W [x, 1]; x' = relu(sum over in-edges of alpha p_src) + x, alpha the softmax of
# leaky(a_dst . p_dst + a_src . p_src) for each head.


def _heads(p: np.ndarray, a: np.ndarray) -> np.ndarray:
    return (p.reshape(len(p), *a.shape) * a).sum(2)


def _leaky(s: Column) -> Column:
    return F.when(s > 0, s).otherwise(s * SLOPE)


def _affine(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def attention_forward(edges: DataFrame, nodes: DataFrame, w: np.ndarray, a_dst: np.ndarray, a_src: np.ndarray, scratch: Scratch) -> DataFrame:
    """(node_id, h, p, l, r, z, o, x): the input, its projection, both halves of the scores, the softmax' sums, the
    mix before relu, the output. Scores are taken less the largest that any edge could have, which cancels out."""
    heads, width = a_dst.shape
    dim = heads * width

    def project(a):
        p = _affine(a["x"], w)
        return {"h": a["x"], "p": p, "l": _heads(p, a_dst), "r": _heads(p, a_src)}

    own = scratch.store(node_map(nodes.select("node_id", "x"), project, ["h", "p", "l", "r"]), "projected")
    top = own.agg(F.max(F.array_max("l")) + F.max(F.array_max("r"))).first()[0] or 0.0
    own = own.withColumn("top", F.lit(top if top > 0 else top * SLOPE))
    e = edges.select("src", "dst").join(own.select(F.col("node_id").alias("src"), "p", "r"), "src").join(own.select(F.col("node_id").alias("dst"), "l", "top"), "dst")
    e = e.select("dst", "p", F.array(*[F.exp(_leaky(F.col("l")[h] + F.col("r")[h]) - F.col("top")) for h in range(heads)]).alias("t"))
    mixed = e.groupBy(F.col("dst").alias("node_id")).agg(_sum_of([F.col("t")[h] for h in range(heads)]).alias("z"), _sum_of([F.col("t")[i // width] * F.col("p")[i] for i in range(dim)]).alias("n"))
    rows = own.join(mixed, "node_id", "left").select("node_id", "h", "p", "l", "r", F.array("top").alias("top"), F.coalesce("z", _zeros(heads)).alias("z"), F.coalesce("n", _zeros(dim)).alias("n"))

    def finish(a):
        o = a["n"] / np.repeat(np.where(a["z"] > 0, a["z"], 1), width, 1)
        return {**a, "o": o, "x": np.maximum(o, 0) + a["h"]}

    return node_map(rows, finish, ["h", "p", "l", "r", "top", "z", "o", "x"])


def attention_backward(edges: DataFrame, state: DataFrame, gradient: DataFrame, w: np.ndarray, a_dst: np.ndarray, a_src: np.ndarray, scratch: Scratch) -> tuple[Arrays, DataFrame]:
    """Gradients of w, a_dst and a_src, and (node_id, g) of the layer's input."""
    heads, width = a_dst.shape
    dim = heads * width

    def local(a):
        d = a["g"] * (a["o"] > 0)
        return {**a, "d": d, "c": (d * a["o"]).reshape(len(d), heads, width).sum(2)}

    both = node_map(state.drop("x").join(gradient, "node_id"), local, ["h", "p", "l", "r", "top", "z", "d", "c", "g"])
    both = scratch.store(both, "attention-backward")
    e = edges.select("src", "dst").join(both.select(F.col("node_id").alias("src"), "p", "r"), "src").join(both.select(F.col("node_id").alias("dst"), "l", F.col("top")[0].alias("top"), "z", "d", "c"), "dst")
    score = [F.col("l")[h] + F.col("r")[h] for h in range(heads)]
    alpha = [F.exp(_leaky(score[h]) - F.col("top")) / F.col("z")[h] for h in range(heads)]
    dot = [sum((F.col("d")[h * width + i] * F.col("p")[h * width + i] for i in range(width)), F.lit(0.0)) for h in range(heads)]
    e = e.select("src", "dst", "d", F.array(*alpha).alias("alpha"), F.array(*[F.when(s > 0, 1.0).otherwise(SLOPE) for s in score]).alias("slope"), F.array(*dot).alias("dot"), "c")
    e = e.select("src", "dst", F.array(*[F.col("slope")[h] * F.col("alpha")[h] * (F.col("dot")[h] - F.col("c")[h]) for h in range(heads)]).alias("e"), F.array(*[F.col("alpha")[i // width] * F.col("d")[i] for i in range(dim)]).alias("v"))
    e = scratch.store(e, "edge-gradients")
    at_dst = e.groupBy(F.col("dst").alias("node_id")).agg(_sum_of([F.col("e")[h] for h in range(heads)]).alias("el"))
    at_src = e.groupBy(F.col("src").alias("node_id")).agg(_sum_of([F.col("e")[h] for h in range(heads)]).alias("er"), _sum_of([F.col("v")[i] for i in range(dim)]).alias("dp"))
    rows = both.select("node_id", "h", "p", "g").join(at_dst, "node_id", "left").join(at_src, "node_id", "left")
    rows = scratch.store(rows.select("node_id", "h", "p", "g", *[F.coalesce(c, _zeros(n)).alias(c) for c, n in (("el", heads), ("er", heads), ("dp", dim))]), "node-gradients")

    def at_p(a):
        return a["dp"] + (a["el"][:, :, None] * a_dst + a["er"][:, :, None] * a_src).reshape(-1, dim)

    def weights(a):
        p, g = a["p"].reshape(-1, heads, width), at_p(a)
        return {"w": np.concatenate([a["h"].T @ g, g.sum(0)[None]]), "a_dst": (a["el"][:, :, None] * p).sum(0), "a_src": (a["er"][:, :, None] * p).sum(0)}

    got = sums(rows, weights)
    back = node_map(rows, lambda a: {"g": a["g"] + at_p(a) @ w[:-1].T}, ["g"])
    return {"w": got["w"].reshape(w.shape), "a_dst": got["a_dst"].reshape(a_dst.shape), "a_src": got["a_src"].reshape(a_src.shape)}, back


# ------------------------------------------------------------------------------------------------
# Transformer block: dot-product attention over in-edges and over a few global centroids, added to the input, layer
# norm, a feed-forward step of twice the width, layer norm. The weights of a layer: q k v o for the edges, gq gk gv go
# for the centroids, centroids, norm1 norm2 (scale, shift), up and down.

EPS = 1e-5
BLOCK = ("q", "k", "v", "o", "gq", "gk", "gv", "go", "centroids", "norm1", "norm2", "up", "down")


def _normed(a: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Layer norm, what comes before scale and shift, and one over the deviation."""
    mid = a - a.mean(1, keepdims=True)
    inv = 1 / np.sqrt((mid * mid).mean(1, keepdims=True) + EPS)
    return mid * inv * norm[0] + norm[1], mid * inv, inv


def _normed_back(g: np.ndarray, hat: np.ndarray, inv: np.ndarray, norm: np.ndarray) -> np.ndarray:
    d = g * norm[0]
    return inv * (d - d.mean(1, keepdims=True) - hat * (d * hat).mean(1, keepdims=True))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def _block(w: Arrays, heads: int, h: np.ndarray, o: np.ndarray) -> Arrays:
    """Everything of the block that happens inside a node, from its input and its mix over edges."""
    n, width = len(h), h.shape[1] // heads
    cut = lambda x: x.reshape(len(x), heads, width)
    gq, gk, gv = cut(_affine(h, w["gq"])), cut(_affine(w["centroids"], w["gk"])), cut(_affine(w["centroids"], w["gv"]))
    s = np.einsum("nhi,chi->nhc", gq, gk) / np.sqrt(width)
    e = np.exp(s - s.max(2, keepdims=True))
    attn = e / e.sum(2, keepdims=True)
    mix = np.einsum("nhc,chi->nhi", attn, gv).reshape(n, -1)
    one, hat1, inv1 = _normed(h + _affine(o, w["o"]) + _affine(mix, w["go"]), w["norm1"])
    up = _affine(one, w["up"])
    out, hat2, inv2 = _normed(one + _affine(np.maximum(up, 0), w["down"]), w["norm2"])
    return {"gq": gq, "gk": gk, "gv": gv, "attn": attn, "mix": mix, "one": one, "hat1": hat1, "inv1": inv1, "up": up, "hat2": hat2, "inv2": inv2, "x": out}


def _block_back(w: Arrays, heads: int, h: np.ndarray, o: np.ndarray, g: np.ndarray) -> tuple[Arrays, np.ndarray, np.ndarray]:
    """Sums for the weights, and gradients of the input (but for the way through q, k and v) and of the mix over edges.
    gk, gv are gradients of the centroids' keys and values, for the driver to take further."""
    c, n, width = _block(w, heads, h, o), len(h), h.shape[1] // heads
    cut = lambda x: x.reshape(n, heads, width)
    b = _normed_back(g, c["hat2"], c["inv2"], w["norm2"])
    d_up = (b @ w["down"][:-1].T) * (c["up"] > 0)
    d_one = b + d_up @ w["up"][:-1].T
    a = _normed_back(d_one, c["hat1"], c["inv1"], w["norm1"])
    d_mix = cut(a @ w["go"][:-1].T)
    d_attn = np.einsum("nhi,chi->nhc", d_mix, c["gv"])
    d_s = c["attn"] * (d_attn - (d_attn * c["attn"]).sum(2, keepdims=True)) / np.sqrt(width)
    d_gq = np.einsum("nhc,chi->nhi", d_s, c["gk"]).reshape(n, -1)
    sums_ = {
        "norm2": np.stack([(g * c["hat2"]).sum(0), g.sum(0)]), "down": _with_one(np.maximum(c["up"], 0)).T @ b, "up": _with_one(c["one"]).T @ d_up, "norm1": np.stack([(d_one * c["hat1"]).sum(0), d_one.sum(0)]),
        "o": _with_one(o).T @ a, "go": _with_one(c["mix"]).T @ a, "gq": _with_one(h).T @ d_gq, "gk": np.einsum("nhc,nhi->chi", d_s, c["gq"]), "gv": np.einsum("nhc,nhi->chi", c["attn"], d_mix),
    }
    return sums_, a + d_gq @ w["gq"][:-1].T, a @ w["o"][:-1].T


def transformer_forward(edges: DataFrame, nodes: DataFrame, w: Arrays, heads: int, scratch: Scratch) -> DataFrame:
    """(node_id, h, q, k, v, shift, z, o, x). A target's scores are taken less a bound of them, which cancels out."""
    dim = w["q"].shape[1]
    width = dim // heads

    def project(a):
        q, k, v = (_affine(a["x"], w[n]) for n in "qkv")
        size = lambda x: np.sqrt((x.reshape(len(x), heads, width) ** 2).sum(2))
        return {"h": a["x"], "q": q, "k": k, "v": v, "qn": size(q) / np.sqrt(width), "kn": size(k)}

    own = scratch.store(node_map(nodes.select("node_id", "x"), project, ["h", "q", "k", "v", "qn", "kn"]), "projected")
    longest = own.agg(*[F.max(F.col("kn")[h]) for h in range(heads)]).first()
    own = own.select("node_id", "h", "q", "k", "v", F.array(*[F.col("qn")[h] * F.lit(float(longest[h] or 0.0)) for h in range(heads)]).alias("shift"))
    e = edges.select("src", "dst").join(own.select(F.col("node_id").alias("src"), "k", "v"), "src").join(own.select(F.col("node_id").alias("dst"), "q", "shift"), "dst")
    e = e.select("dst", "v", F.array(*[F.exp(_score(h, width) - F.col("shift")[h]) for h in range(heads)]).alias("t"))
    mixed = e.groupBy(F.col("dst").alias("node_id")).agg(_sum_of([F.col("t")[h] for h in range(heads)]).alias("z"), _sum_of([F.col("t")[i // width] * F.col("v")[i] for i in range(dim)]).alias("n"))
    rows = own.join(mixed, "node_id", "left").select(*own.columns, F.coalesce("z", _zeros(heads)).alias("z"), F.coalesce("n", _zeros(dim)).alias("n"))

    def finish(a):
        o = a["n"] / np.repeat(np.where(a["z"] > 0, a["z"], 1), width, 1)
        return {**a, "o": o, "x": _block(w, heads, a["h"], o)["x"]}

    return node_map(rows, finish, ["h", "q", "k", "v", "shift", "z", "o", "x"])


def _score(h: int, width: int) -> Column:
    return sum((F.col("q")[h * width + i] * F.col("k")[h * width + i] for i in range(width)), F.lit(0.0)) / float(np.sqrt(width))


def transformer_backward(edges: DataFrame, state: DataFrame, gradient: DataFrame, w: Arrays, heads: int, scratch: Scratch) -> tuple[Arrays, DataFrame]:
    """Gradients of the layer's weights, and (node_id, g) of its input."""
    dim = w["q"].shape[1]
    width = dim // heads

    def local(a):
        _, own, d = _block_back(w, heads, a["h"], a["o"], a["g"])
        return {**a, "own": own, "d": d, "c": (d * a["o"]).reshape(len(d), heads, width).sum(2)}

    with_g = scratch.store(state.drop("x").join(gradient, "node_id"), "block-backward")
    got = sums(with_g, lambda a: _block_back(w, heads, a["h"], a["o"], a["g"])[0])
    both = scratch.store(node_map(with_g, local, ["h", "q", "k", "v", "shift", "z", "d", "c", "own"]), "block-gradients")
    e = edges.select("src", "dst").join(both.select(F.col("node_id").alias("src"), "k", "v"), "src").join(both.select(F.col("node_id").alias("dst"), "q", "shift", "z", "d", "c"), "dst")
    alpha = [F.exp(_score(h, width) - F.col("shift")[h]) / F.col("z")[h] for h in range(heads)]
    dot = [sum((F.col("d")[h * width + i] * F.col("v")[h * width + i] for i in range(width)), F.lit(0.0)) for h in range(heads)]
    e = e.select("src", "dst", "q", "k", "d", F.array(*alpha).alias("alpha"), F.array(*dot).alias("dot"), "c")
    e = e.select("src", "dst", "q", "k", "d", "alpha", F.array(*[F.col("alpha")[h] * (F.col("dot")[h] - F.col("c")[h]) / float(np.sqrt(width)) for h in range(heads)]).alias("s"))
    e = scratch.store(e, "edge-gradients")
    at_dst = e.groupBy(F.col("dst").alias("node_id")).agg(_sum_of([F.col("s")[i // width] * F.col("k")[i] for i in range(dim)]).alias("dq"))
    at_src = e.groupBy(F.col("src").alias("node_id")).agg(_sum_of([F.col("s")[i // width] * F.col("q")[i] for i in range(dim)]).alias("dk"), _sum_of([F.col("alpha")[i // width] * F.col("d")[i] for i in range(dim)]).alias("dv"))
    rows = both.select("node_id", "h", "own").join(at_dst, "node_id", "left").join(at_src, "node_id", "left")
    rows = scratch.store(rows.select("node_id", "h", "own", *[F.coalesce(c, _zeros(dim)).alias(c) for c in ("dq", "dk", "dv")]), "node-gradients")
    got |= sums(rows, lambda a: {n: _with_one(a["h"]).T @ a[f"d{n}"] for n in "qkv"})
    out = {n: got[n].reshape(w[n].shape) for n in BLOCK if n not in ("gk", "gv", "centroids")}
    keys, values = (got[n].reshape(-1, dim) for n in ("gk", "gv"))
    out |= {"gk": _with_one(w["centroids"]).T @ keys, "gv": _with_one(w["centroids"]).T @ values, "centroids": keys @ w["gk"][:-1].T + values @ w["gv"][:-1].T}
    return out, node_map(rows, lambda a: {"g": a["own"] + sum(a[f"d{n}"] @ w[n][:-1].T for n in "qkv")}, ["g"])
