"""Message passing as joins and grouped aggregates. Features are (node_id, x array<double>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.functions.scalars import dot, leaky_relu, squared_distance


def _gathered(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Each edge with its source's features."""
    return edges.join(features.select(F.col("node_id").alias("src"), "x"), "src")


def _long(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.posexplode("x").alias("pos", "v"))


def _vectors(agg: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, v) back to arrays; an array has as many parts as the features have dimensions."""
    return agg.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("x"))


def scatter(edges: DataFrame, features: DataFrame, how: str = "sum", by: tuple[str, ...] = ("dst",), weight: str | None = None) -> DataFrame:
    """Sum, mean or max of the neighbours' vectors per target (and relation); targets without edges are absent.

    With a weight column the sum is of weight * x and the mean is divided by the weights."""
    rows = _gathered(edges, features)
    if weight:
        w = F.col(weight).cast("double")
        long = rows.select(*by, w.alias("w"), F.posexplode("x").alias("pos", "v"))
        total = F.sum(F.col("w") * F.col("v"))
        agg = {"sum": total, "mean": total / F.sum("w")}[how]
    else:
        long, agg = _long(rows, *by), {"sum": F.sum("v"), "mean": F.avg("v"), "max": F.max("v")}[how]
    return _vectors(long.groupBy(*by, "pos").agg(agg.alias("v")), *by)


def filled(per_node: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """(node_id, x) for all nodes, zeros where there was no message."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return nodes.select("node_id").join(per_node.withColumnRenamed("dst", "node_id"), "node_id", "left").select("node_id", F.coalesce("x", zero).alias("x"))


def edge_softmax(edges: DataFrame, score: str, by: str = "dst", out: str = "alpha") -> DataFrame:
    """Softmax of the scores over each target's edges, after taking off the largest score of all."""
    top = edges.agg(F.max(score).alias("_top"))
    # sums are pre-aggregated and joined back, so a target with very many edges is not one task's window
    e = edges.crossJoin(F.broadcast(top)).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = e.groupBy(by).agg(F.sum("_e").alias("_z"))
    return e.join(total, by).withColumn(out, F.col("_e") / (F.col("_z") + 1e-16)).drop("_e", "_z", "_top")


def attention(edges: DataFrame, features: DataFrame, a_src: list[float], a_dst: list[float]) -> DataFrame:
    """One attention head: softmax over in-edges of LeakyReLU(a_dst . x_dst + a_src . x_src), then the weighted sum."""
    vec = lambda a: F.array(*[F.lit(float(x)) for x in a])
    part = features.select("node_id", dot(F.col("x"), vec(a_src)).alias("_ps"), dot(F.col("x"), vec(a_dst)).alias("_pd"))
    e = edges.join(part.select(F.col("node_id").alias("src"), "_ps"), "src").join(part.select(F.col("node_id").alias("dst"), "_pd"), "dst")
    scored = edge_softmax(e.withColumn("_score", leaky_relu(F.col("_ps") + F.col("_pd"))), "_score")
    return scatter(scored.select("src", "dst", "alpha"), features, "sum", weight="alpha")


def khop_mean(edges: DataFrame, features: DataFrame, hops: int) -> list[DataFrame]:
    """Features, then their means over in-neighbours after 1 to ``hops`` steps; nodes without in-edges keep 0."""
    dims = features.select(F.size("x").alias("d")).limit(1).first()
    out = [features]
    for _ in range(hops):
        out.append(filled(scatter(edges, out[-1], "mean"), features, dims["d"] if dims else 0))
    return out


def sage_layer(edges: DataFrame, features: DataFrame, own: list[list[float]], relations: dict[int, list[list[float]]]) -> DataFrame:
    """relu(W h + sum over relations of W_r mean_r(h)), with given weights (rows are outputs)."""
    mat = lambda w: F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])
    apply = lambda w, x: F.transform(mat(w), lambda row: dot(row, x))
    means = scatter(edges.where(F.col("etype").isin(list(relations))), features, "mean", ("dst", "etype"))
    case = None
    for r, w in relations.items():
        case = F.when(F.col("etype") == r, apply(w, F.col("x"))) if case is None else case.when(F.col("etype") == r, apply(w, F.col("x")))
    parts = means.select(F.col("dst").alias("node_id"), case.alias("x")).unionByName(features.select("node_id", apply(own, F.col("x")).alias("x")))
    total = _vectors(_long(parts, "node_id").groupBy("node_id", "pos").agg(F.sum("v").alias("v")), "node_id")
    return total.withColumn("x", F.transform("x", lambda v: F.greatest(v, F.lit(0.0))))


def centroid_attention(features: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each node's attention over a small table of centroids (cid, c) and the mix of them."""
    one = centroids.agg(F.sort_array(F.collect_list(F.struct("cid", "c"))).alias("cs"))  # centroids are a parameter: a bounded row
    rows = features.crossJoin(F.broadcast(one))
    scores = F.transform("cs", lambda c: dot(F.col("x"), c["c"]) / F.sqrt(F.size("x").cast("double")))
    rows = rows.withColumn("_s", scores).withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))))
    rows = rows.withColumn("attention", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
    return rows.select("node_id", "attention")


def nearest_centroid(features: DataFrame, centroids: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, cid, distance2) and the columns to ``keep``; ties go to the smaller cid."""
    one = centroids.agg(F.collect_list(F.struct("cid", "c")).alias("cs"))
    best = F.array_min(F.transform("cs", lambda c: F.struct(squared_distance(F.col("x"), c["c"]).alias("d"), c["cid"].alias("cid"))))
    return features.crossJoin(F.broadcast(one)).withColumn("_b", best).select("node_id", F.col("_b.cid").alias("cid"), F.col("_b.d").alias("distance2"), *keep)


def kmeans(features: DataFrame, centroids: DataFrame, rounds: int = 10) -> DataFrame:
    """Lloyd's centroids (cid, c) from the given ones; a cluster that loses all its nodes keeps its centre."""
    now = centroids.select("cid", "c")
    first = now.select(F.size("c")).first()
    for _ in range(rounds if first else 0):
        near = nearest_centroid(features, now, ("x",))
        new = near.groupBy("cid").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(first[0])]).alias("_new"))
        rows = now.join(new, "cid", "left").select("cid", F.coalesce("_new", "c").alias("c")).collect()  # k rows
        now = features.sparkSession.createDataFrame(rows, now.schema)
    return now


def element_mean(df: DataFrame, column: str) -> DataFrame:
    """Element-wise mean of all vectors, such as workers' gradients."""
    long = df.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v"))
    return long.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("mean"))


def ensemble(df: DataFrame, by: str, prediction: str, weight: str | None = None) -> DataFrame:
    """Average, weighted average and majority (ties to the smaller) of several models' predictions."""
    votes = df.withColumn("_vote", F.round(prediction)).groupBy(by, "_vote").agg(F.count("*").alias("_n"), F.sum(prediction).alias("_s"), F.sum(F.col(weight) * F.col(prediction) if weight else F.col(prediction)).alias("_ws"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("_w"))
    return votes.groupBy(by).agg((F.sum("_s") / F.sum("_n")).alias("average"), (F.sum("_ws") / F.sum("_w")).alias("weighted"), F.min_by("_vote", F.struct(-F.col("_n"), F.col("_vote"))).alias("majority"))




def _matrix(w: list[list[float]]):
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])


def _times(w: list[list[float]], x):
    return F.transform(_matrix(w), lambda row: dot(row, x))


def basis_weights(bases: list[list[list[float]]], mix: dict[int, list[float]]) -> dict[int, list[list[float]]]:
    """Relations' weights as sums of shared bases: W_r = sum over b of mix[r][b] B_b."""
    rows, cols = len(bases[0]), len(bases[0][0])
    return {r: [[sum(a * m[i][j] for a, m in zip(coef, bases, strict=True)) for j in range(cols)] for i in range(rows)] for r, coef in mix.items()}


def edge_conv(edges: DataFrame, features: DataFrame, edge_vector: str, w: list[list[float]], w_edge: list[list[float]]) -> DataFrame:
    """(node_id, x): sum over in-edges of W h_j + W_e e_ij, plus W h_i; nodes without in-edges keep W h_i."""
    dim = len(w)
    own = features.select("node_id", _times(w, F.col("x")).alias("x"))
    sent = edges.join(own.toDF("src", "x"), "src").select("dst", F.zip_with("x", _times(w_edge, F.col(edge_vector)), lambda a, b: a + b).alias("x"))
    sums = sent.groupBy(F.col("dst").alias("node_id")).agg(F.array(*[F.sum(F.col("x")[i]) for i in range(dim)]).alias("m"))
    return own.join(sums, "node_id", "left").select("node_id", F.when(F.col("m").isNull(), F.col("x")).otherwise(F.zip_with("x", "m", lambda a, b: a + b)).alias("x"))


def multi_head_attention(edges: DataFrame, features: DataFrame, heads: list[tuple[list[list[float]], list[float], list[float]]]) -> DataFrame:
    """(node_id, x): for each head (W, a_src, a_dst) the attention over in-edges of W h, one head after the other;
    nodes without in-edges are absent."""
    out = None
    for i, (w, a_src, a_dst) in enumerate(heads):
        one = attention(edges, features.select("node_id", _times(w, F.col("x")).alias("x")), a_src, a_dst)
        one = one.select(F.col(one.columns[0]).alias("node_id"), F.col("x").alias(f"_x{i}"))
        out = one if out is None else out.join(one, "node_id")
    return out.select("node_id", F.concat(*[f"_x{i}" for i in range(len(heads))]).alias("x"))


def concatenated(edges: DataFrame, features: DataFrame, order: str) -> DataFrame:
    """(dst, x): the neighbours' vectors one after the other, by ``order`` of the edges."""
    rows = _gathered(edges, features).groupBy("dst").agg(F.sort_array(F.collect_list(F.struct(order, "x"))).alias("_l"))
    return rows.select("dst", F.flatten(F.transform("_l", lambda r: r["x"])).alias("x"))
