"""Strongly connected components, and with them the vertices that are on a cycle.

Three reductions shrink the graph until nothing is left. Trimming takes off vertices without in- or out-edges. Chains, runs of
vertices with one edge in and one out, become one vertex each; their ends are found as connected components, in a number
of rounds that grows with the logarithm of the longest chain. What is left is coloured: the largest id that reaches a
vertex spreads forwards until it settles, and each vertex that kept its own id spreads backwards within its colour; whom it
meets is its component (Orzan, 2004).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.operators.components import connected_components
from relmill.staging import Scratch


def _trimmed(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """Edges whose source has an in-edge and whose target has an out-edge; the share of edges that went."""
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    kept = scratch.store(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "trimmed")
    before = edges.count()
    gone = (before - kept.count()) / max(1, before)
    scratch.drop(edges)
    return kept, gone


def _contracted(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The graph with each chain as one vertex, its smallest; (node, chain) of the vertices so merged; (node, component)
    of closed chains, which are cycles of their own and leave the graph. Nothing for the last two where there is none."""
    inner = edges.groupBy("src").agg(F.count("*").alias("_o")).where("_o = 1").select("src").join(edges.groupBy(F.col("dst").alias("src")).agg(F.count("*").alias("_i")).where("_i = 1").select("src"), "src")
    inner = scratch.store(inner, "inner")
    links = scratch.store(edges.join(inner, "src", "left_semi").join(inner.withColumnRenamed("src", "dst"), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b")), "chain-links")
    if not links.take(1):
        return edges, None, None
    chains = scratch.store(connected_components(links, scratch), "chains")
    count = chains.groupBy("component").agg(F.count("*").alias("n"))
    inside = links.join(chains.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count("*").alias("m"))
    closed = scratch.store(count.join(inside, "component").where("n = m").select("component"), "closed")
    cycles = scratch.store(chains.join(closed, "component", "left_semi").select("node", "component"), "cycles")
    merged = scratch.store(chains.join(closed, "component", "left_anti").select("node", F.col("component").alias("chain")), "merged")
    left = edges.join(cycles.select(F.col("node").alias("src")), "src", "left_anti").join(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), ["src", "dst"], "left_anti")
    of = lambda side: merged.select(F.col("node").alias(side), F.col("chain").alias(f"_{side}"))
    left = left.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).distinct()
    return scratch.store(left, "contracted"), merged if merged.take(1) else None, cycles if cycles.take(1) else None


def _spread(edges: DataFrame, start: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, colour): the largest colour that reaches each vertex along edges; only what has grown is sent again."""
    now, fresh = start, start
    while True:
        sent = edges.join(fresh.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("_c"))
        new = now.join(sent, "id", "left").select("id", F.greatest("colour", "_c").alias("colour"), (F.col("_c") > F.col("colour")).alias("grown"))
        new = scratch.store(new.select("id", "colour", F.coalesce("grown", F.lit(False)).alias("grown")), "colours")
        if now is not start:
            scratch.drop(now)
        now, fresh = new, new.where("grown")
        if not fresh.take(1):
            return now.select("id", "colour")


def _coloured(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, component) of one component for each colour, and the edges between the rest."""
    start = scratch.store(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").cast("long").alias("colour")), "start")
    forth = scratch.store(_spread(edges, start, scratch), "forth")
    within = edges.join(forth.toDF("src", "c1"), "src").join(forth.toDF("dst", "c2"), "dst").where("c1 = c2").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    none = F.lit(-(2**63)).cast("long")
    roots = forth.select("id", F.when(F.col("id") == F.col("colour"), F.col("colour")).otherwise(none).alias("colour"))
    back = _spread(scratch.store(within, "within"), scratch.store(roots, "roots"), scratch)
    found = scratch.store(back.where(F.col("colour") > none).select(F.col("id").alias("node"), F.col("colour").alias("component")), "found")
    left = edges.join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
    return found, scratch.store(left.select("src", "dst"), "edges")


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, size, on_cycle): component is the smallest id of those that reach each other; a vertex is on a
    cycle if its component has several or it has an edge to itself. Edges of other vertices add theirs; null ends are left
    out; repeated vertices and edges count once."""
    scratch = Scratch(edges.sparkSession, merge=True)
    known = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    ids = scratch.store(vertices.select("id").where("id is not null").unionByName(known.select(F.explode(F.array("src", "dst")).alias("id"))).distinct(), "vertices")
    loops = scratch.store(known.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop")), "loops")
    now = scratch.store(known.where("src <> dst"), "edges")
    merges, parts = [], []  # (node, chain), innermost last; (node, component) of what is settled
    while now.take(1):
        now, gone = _trimmed(now, scratch)
        if gone >= 0.1:
            continue  # layers go fast enough by themselves
        now, merged, cycles = _contracted(now, scratch)
        if cycles is not None:
            parts.append(cycles)
        if merged is not None:
            merges.append(merged)
        elif cycles is None and not gone and now.take(1):
            found, now = _coloured(now, scratch)
            parts.append(found)
    of = ids.select(F.col("id").alias("node"), F.col("id").alias("component"))
    if parts:
        settled = scratch.store(reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.min("component").alias("component")), "settled")
        for m in reversed(merges):  # a merged vertex has its chain's component
            own = m.join(settled.select(F.col("node").alias("chain"), "component"), "chain").select("node", "component")
            settled = scratch.store(settled.join(own.select("node"), "node", "left_anti").unionByName(own), "settled")
        of = ids.select(F.col("id").alias("node")).join(settled.withColumnRenamed("component", "_c"), "node", "left").select("node", F.coalesce("_c", "node").alias("component"))
    of = scratch.store(of, "components")
    sizes = scratch.store(of.groupBy("component").agg(F.min("node").alias("_least"), F.count("*").alias("size")), "sizes")  # plain shuffles: a giant component is split
    out = of.join(sizes, "component").join(loops.withColumnRenamed("id", "node"), "node", "left")
    return out.select(F.col("node").alias("id"), F.col("_least").alias("component"), "size", (F.coalesce("loop", F.lit(False)) | (F.col("size") > 1)).alias("on_cycle"))
