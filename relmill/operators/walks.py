"""Second-order random walks by drawn places and rejection.

Edges are numbered once over all nodes, so that a node's ways on are a run of numbers. A step draws one number inside the run
of the walk's node and looks it up: a row per walk, however many neighbours the node has, and the lookup's keys are
all different, so a hub is no hot key there. The weights of node2vec (Grover and Leskovec, 2016) come in by rejection: a
drawn way is taken with its weight over the largest one, or else drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmill.operators.ordered import row_index
from relmill.staging import Scratch


def numbered_ways(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(at, next) of every distinct edge, in order of source and target, and (node, first, degree)."""
    ways = scratch.store(row_index(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), ["src", "dst"], "at"), "ways")
    runs = scratch.store(ways.groupBy(F.col("src").alias("node")).agg(F.min("at").alias("first"), F.count("*").alias("degree")), "runs")
    return ways.select("at", F.col("dst").alias("next")), runs


def _draw(seed: int, step: int, at: int, digits: int) -> Column:
    text = F.concat_ws(":", F.col("walk").cast("string"), F.lit(f"{seed}:{step}"), F.col("attempt").cast("string"))
    return F.conv(F.substring(F.md5(text), at, digits), 16, 10).cast("long")


def node2vec_walks(edges: DataFrame, starts: DataFrame, length: int, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """(walk, step, node) of walks of up to ``length`` steps; going back weighs 1/p, a neighbour of the last node 1, others 1/q.

    starts: (walk, node), one row a walk. Parallel edges count once, null ends not at all. A walk ends where there is no
    way on. Draws are digests of walk, step, attempt and seed, so reruns agree. Attempts come in rounds of 1, 2, 4 and so on
    for the walks that are still rejected, and the first that is taken counts; so a step has about the logarithm of its
    slowest walk's attempts as rounds, and a few rows a walk in all.
    """
    if length <= 0 or p <= 0 or q <= 0:
        raise ValueError("length, p and q must be positive")
    scratch = Scratch(edges.sparkSession)
    ways, runs = numbered_ways(edges, scratch)
    known = edges.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("near")).distinct()
    known = scratch.store(known, "known") if p != 1 or q != 1 else known
    largest = max(1 / p, 1.0, 1 / q)
    now = starts.select("walk", F.lit(None).cast("long").alias("prev"), F.col("node").cast("long").alias("node"))
    out = [now.select("walk", F.lit(0).alias("step"), "node")]
    for step in range(1, length + 1):
        left, moved, attempt, batch = scratch.store(now.join(runs.hint("merge"), "node"), "standing"), [], 0, 1
        while True:
            drawn = left.withColumn("attempt", F.explode(F.sequence(F.lit(attempt), F.lit(attempt + batch - 1))))
            drawn = drawn.withColumn("at", F.col("first") + _draw(seed, step, 1, 15) % F.col("degree")).join(ways.hint("merge"), "at")
            if p == 1 and q == 1:
                moved.append(drawn.select("walk", F.col("node").alias("prev"), F.col("next").alias("node")))
                break
            weight = F.when(F.col("prev").isNull(), largest).when(F.col("next") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
            taken = (_draw(seed, step, 16, 7) + 0.5) / float(16**7) * largest < weight
            drawn = drawn.join(known.hint("merge"), ["prev", "next"], "left").where(taken)
            first = drawn.groupBy("walk").agg(F.min_by(F.struct(F.col("node").alias("prev"), F.col("next").alias("node")), "attempt").alias("m"))
            moved.append(scratch.store(first.select("walk", "m.prev", "m.node"), "moved"))
            left = scratch.store(left.join(moved[-1].select("walk"), "walk", "left_anti"), "standing")
            attempt, batch = attempt + batch, 2 * batch
            if not left.take(1):
                break
        now = moved[0]
        for m in moved[1:]:
            now = now.unionByName(m)
        now = scratch.store(now, "step")
        out.append(now.select("walk", F.lit(step).alias("step"), "node"))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows
