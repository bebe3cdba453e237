"""Communities by modularity, and spectral clusters by power iteration."""

from __future__ import annotations

from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.staging import Scratch


def louvain(vertices: DataFrame, edges: DataFrame, weight: str | None = None, levels: int = 10, rounds: int = 20, resolution: float = 1.0, gain: float = 1e-6) -> DataFrame:
    """(id, community): Louvain (Blondel et al., 2008); a community is named by its smallest vertex.

    On each level vertices move to the neighbouring community with the largest gain in modularity, the smallest
    one among equals, until the modularity stays; communities then become vertices and their edges add up. Moves are
    made at once, by half of the vertices in turn, so that neighbours do not swap forever. Edges are undirected,
    parallel ones add up; isolated vertices are communities of their own.
    """
    scratch = Scratch(edges.sparkSession, merge=True)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    graph = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    graph = scratch.store(graph, "graph")
    total = graph.agg(F.sum("w")).first()[0] or 0.0
    placed = vertices.select("id", F.col("id").alias("community"))
    if not total:
        return placed
    for _ in range(levels):
        both = graph.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("other"), "w").unionByName(graph.where("a <> b").select(F.col("b").alias("id"), F.col("a").alias("other"), "w"))
        both = scratch.store(both, "neighbours")
        ends = graph.select(F.explode(F.array("a", "b")).alias("id"), "w")
        degree = scratch.store(ends.groupBy("id").agg(F.sum("w").alias("k")), "degrees")
        now = scratch.store(degree.select("id", "k", F.col("id").alias("c")), "level")

        def quality(state: DataFrame) -> float:
            inner = graph.join(state.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(state.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
            inside = inner.where("ca = cb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
            squares = state.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
            return inside / total - resolution * squares / (4 * total * total)

        begin = best = quality(now)
        stale = 0
        for turn in range(rounds):
            sums = scratch.store(now.groupBy("c").agg(F.sum("k").alias("s")), "sums")  # plain shuffles: a large community is split
            links = both.join(now.select(F.col("id").alias("other"), "c"), "other").groupBy("id", "c").agg(F.sum("w").alias("l"))
            own = now.select("id", "k", F.col("c").alias("mine"))
            offers = links.unionByName(own.select("id", F.col("mine").alias("c"), F.lit(0.0).alias("l"))).groupBy("id", "c").agg(F.sum("l").alias("l"))
            offers = offers.join(own, "id").join(sums, "c")
            rest = F.col("s") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)
            value = F.col("l") - resolution * F.col("k") * rest / (2 * total)
            pick = offers.groupBy("id").agg(F.max(F.struct(F.round(value, 9).alias("v"), (-F.col("c")).alias("m"))).alias("p"), F.max(F.when(F.col("c") == F.col("mine"), F.round(value, 9))).alias("stay"))
            moves = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
            new = now.join(pick, "id").select("id", "k", F.when(moves & (F.col("p.v") > F.col("stay")), -F.col("p.m")).otherwise(F.col("c")).alias("c"))
            new = scratch.store(new, "level")
            scratch.drop(sums)
            score = quality(new)
            if score > best + gain:
                now, best, stale = new, score, 0
            else:
                stale += 1
                if stale == 2:  # neither half finds a move
                    break
        names = scratch.store(now.groupBy("c").agg(F.min("id").alias("name")), "names")
        named = scratch.store(now.join(names, "c").select("id", "name"), "named")
        placed = scratch.store(placed.join(named.withColumnRenamed("id", "community"), "community", "left").select("id", F.coalesce("name", "community").alias("community")), "placed")
        if best - begin < gain:
            break
        x = graph.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
        graph = scratch.store(x.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), "graph")
    smallest = scratch.store(placed.groupBy("community").agg(F.min("id").alias("name")), "smallest")
    return placed.join(smallest, "community").select("id", F.col("name").alias("community"))


def spectral_clusters(edges: DataFrame, k: int, rounds: int = 20, weight: str | None = None) -> DataFrame:
    """(id, cluster) by power iteration on the edges' affinities (Lin and Cohen, 2010), which stands for the leading
    eigenvectors of the normalised graph. Edges are undirected; vertices without edges are absent."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), w.alias("weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    return PowerIterationClustering(k=k, maxIter=rounds, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(pairs).select("id", "cluster")
