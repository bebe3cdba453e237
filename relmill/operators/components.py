"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.staging import Scratch, files_for


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint of undirected ``edges``; component is the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Minima
    are pre-aggregated per map task and stored, so that the join that hands them back reads plain
    shuffles and adaptive execution can split a hub's rows. Null endpoints are dropped, a self-loop
    keeps its node as a component of its own, and an empty input gives an empty result.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = ends.where("a = b").select(F.col("a").alias("u")).distinct()
    cur = scratch.store(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    state = cur.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first()
    first = cur
    for _ in range(rounds):
        if not state[0]:
            break
        n = files_for(2 * state[0])
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low", n)
        large = scratch.store(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large", n
        )
        low2 = scratch.store(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low2", n)
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.store(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "cc-edges", n)
        now = new.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))).first()
        for old in (low, large, low2, *([cur] if cur is not first else [])):
            scratch.drop(old)
        cur, same, state = new, now == state, now
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = members.unionByName(roots)
    alone = loops.select(F.col("u").alias("node")).join(scratch.shuffled(known.select("node")), "node", "left_anti")
    return known.unionByName(alone.select("node", F.col("node").alias("component")))
