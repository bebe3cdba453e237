"""Neighbour sampling, walks and importance. Choices are digests of ids and a seed, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmill.functions.scalars import temporal_decay
from relmill.operators.graph import induced
from relmill.staging import Scratch


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def neighbour_sample(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0, seed_time: float | None = None, recent_first: bool = False) -> DataFrame:
    """(hop, src, dst): up to ``fanout`` in-neighbours of each frontier node per hop, without replacement.

    With ``seed_time`` only edges known by then are used; ``recent_first`` takes the latest instead of a
    random choice. The seeds are a table with node_id.
    """
    if not fanouts or any(f <= 0 for f in fanouts):
        raise ValueError("fanouts must be positive")
    scratch = Scratch(edges.sparkSession)
    known = edges if seed_time is None else edges.where(F.col("etime") <= seed_time)
    pairs = known.groupBy("src", "dst").agg(F.max("etime").alias("etime")) if "etime" in edges.columns else known.select("src", "dst").distinct().withColumn("etime", F.lit(0.0))
    frontier, out = seeds.select(F.col("node_id").alias("dst")).distinct(), None
    for hop, fanout in enumerate(fanouts, 1):
        draw = _digest(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(f"{seed}:{hop}"))
        order = [F.col("etime").desc(), F.col("_d"), F.col("src")] if recent_first else [F.col("_d"), F.col("src")]
        picked = pairs.join(frontier.hint("merge"), "dst", "left_semi").withColumn("_d", draw)
        picked = picked.withColumn("_k", F.row_number().over(Window.partitionBy("dst").orderBy(*order))).where(F.col("_k") <= fanout)
        picked = scratch.store(picked.select(F.lit(hop).alias("hop"), "src", "dst"), "hop")
        out = picked if out is None else out.unionByName(picked)
        frontier = picked.select(F.col("src").alias("dst")).distinct()
    return out


def random_walks(edges: DataFrame, starts: DataFrame, length: int, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """(walk, step, node): second-order walks. Going back weighs 1/p, a neighbour of the last node 1, others 1/q.

    starts: (walk, node). Each step draws the least of -ln(u) / weight over the neighbours, which picks one in
    proportion to the weights in a single pre-aggregated minimum. A walk stops where there is no way on.
    """
    if length <= 0 or p <= 0 or q <= 0:
        raise ValueError("length, p and q must be positive")
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.store(edges.select("src", "dst").distinct(), "pairs")
    now = starts.select("walk", F.lit(None).cast("long").alias("prev"), F.col("node").cast("long").alias("node"))
    out = now.select("walk", F.lit(0).alias("step"), "node")
    known = pairs.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("near"))
    for step in range(1, length + 1):
        ways = now.join(pairs.toDF("node", "next"), "node").join(known, ["prev", "next"], "left")
        weight = F.when(F.col("prev").isNull(), 1.0).when(F.col("next") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
        u = (F.conv(F.substring(_digest(F.col("walk").cast("string"), F.col("next").cast("string"), F.lit(f"{seed}:{step}")), 1, 7), 16, 10).cast("long") + 0.5) / float(16**7)
        best = ways.groupBy("walk", "node").agg(F.min_by("next", F.struct(-F.log(u) / weight, F.col("next"))).alias("next"))
        now = scratch.store(best.select("walk", F.col("node").alias("prev"), F.col("next").alias("node")), "step")
        out = out.unionByName(now.select("walk", F.lit(step).alias("step"), "node"))
    return out


def importance(nodes: DataFrame, edges: DataFrame, as_of: float, decay_days: float = 30.0) -> DataFrame:
    """0.4 degree/(N-1) + 0.3 temporal decay (0.5 without a time) + 0.3 share of the largest degree.

    nodes: node_id, time in seconds or -inf."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    rows = nodes.select("node_id", "time").join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    both = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"), F.max("degree").alias("_top"))))
    fresh = F.when(F.col("time") == float("-inf"), 0.5).otherwise(temporal_decay(F.greatest(F.lit(as_of) - F.col("time"), F.lit(0.0)), decay_days))
    score = 0.4 * F.col("degree") / F.greatest(F.col("_n") - 1, F.lit(1)) + 0.3 * fresh + 0.3 * F.col("degree") / F.greatest("_top", F.lit(1))
    return both.select("node_id", "degree", score.alias("importance"))


def importance_sample(scores: DataFrame, edges: DataFrame, threshold: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` best nodes over a threshold and the edges between them."""
    kept = scores.where(F.col("importance") >= threshold).orderBy(F.col("importance").desc(), "node_id").limit(most)
    return kept, induced(edges, kept)


def walk_subgraph(walks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id) and edges (src, dst) that walks (walk, step, node) pass, once each."""
    nodes = walks.select(F.col("node").alias("node_id")).distinct()
    after = walks.select("walk", (F.col("step") - 1).alias("step"), F.col("node").alias("dst"))
    return nodes, walks.select("walk", "step", F.col("node").alias("src")).join(after, ["walk", "step"]).select("src", "dst").distinct()


def typed_sample(edges: DataFrame, seeds: DataFrame, fanout: dict[int, int], seed: int = 0) -> DataFrame:
    """(etype, src, dst): up to fanout[etype] in-neighbours of each seed over each relation, by hashed order."""
    out = None
    for etype, n in sorted(fanout.items()):
        part = neighbour_sample(edges.where(F.col("etype") == etype), seeds, [n], seed).select(F.lit(etype).alias("etype"), "src", "dst")
        out = part if out is None else out.unionByName(part)
    return out


def sampled_inputs(sample: DataFrame, seeds: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A sample's nodes with a local number each, from 0, and features, and its edges by local numbers."""
    from relmill.operators.ordered import row_index

    nodes = seeds.select("node_id").unionByName(sample.select(F.col("src").alias("node_id"))).unionByName(sample.select(F.col("dst").alias("node_id"))).distinct()
    nodes = row_index(nodes, ["node_id"], "local")
    edges = sample.join(nodes.toDF("src", "a"), "src").join(nodes.toDF("dst", "b"), "dst").select("hop", F.col("a").alias("src"), F.col("b").alias("dst"))
    return nodes.join(features, "node_id", "left"), edges


def seed_subgraphs(edges: DataFrame, batches: DataFrame, fanouts: list[int], seed: int = 0) -> DataFrame:
    """(graph_id, hop, src, dst): the sampled neighbourhoods of many seed sets (graph_id, node_id) in one pass. A node
    of several graphs is sampled once and belongs to each, so graphs are told apart by their id alone."""
    out, front = None, batches.select("graph_id", "node_id").distinct()
    for hop, n in enumerate(fanouts, 1):
        drawn = neighbour_sample(edges, front.select("node_id").distinct(), [n], seed + hop).select("src", "dst")
        part = front.withColumnRenamed("node_id", "dst").join(drawn, "dst").select("graph_id", F.lit(hop).alias("hop"), "src", "dst")
        out = part if out is None else out.unionByName(part)
        front = part.select("graph_id", F.col("src").alias("node_id")).distinct()
    return out


def without_nodes(nodes: DataFrame, edges: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Node dropout: a digest of node and seed decides which nodes go, and their edges with them."""
    u = F.conv(F.substring(_digest(F.col("node_id").cast("string"), F.lit(str(seed))), 1, 7), 16, 10).cast("long") / float(16**7)
    kept = nodes.where(u >= share)
    return kept, induced(edges, kept)


def window_subgraph(edges: DataFrame, seeds: DataFrame, since: float, until: float, hops: int) -> tuple[DataFrame, DataFrame]:
    """The subgraph of a time window around seeds (node_id), in one call: (node_id, hop) of the nodes whose messages reach
    a seed in up to ``hops`` steps, the seeds at 0, and the edges (src, dst, etype, etime) between those nodes.

    Edges count if their time is from ``since`` to ``until``, both included, or if they have none (-inf). A node that is
    reached by several ways has its least hop; only nodes that are new are searched from.
    """
    if hops < 1:
        raise ValueError("hops must be positive")
    scratch = Scratch(edges.sparkSession)
    known = scratch.store(edges.where(F.col("etime").between(since, until) | (F.col("etime") == float("-inf"))), "window")
    pairs = scratch.store(known.select("src", "dst").distinct(), "pairs")
    layer = scratch.store(seeds.select("node_id", F.lit(0).alias("hop")).where("node_id is not null").distinct(), "layer")
    found = layer
    for hop in range(1, hops + 1):
        ways = pairs.join(layer.select(F.col("node_id").alias("dst")), "dst").select(F.col("src").alias("node_id")).distinct()
        layer = scratch.store(ways.join(found.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(hop).alias("hop")), "layer")
        if not layer.take(1):
            break
        found = found.unionByName(layer)
    ids = scratch.store(found.select("node_id"), "nodes")
    inside = known.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return found, inside.select("src", "dst", "etype", "etime")
