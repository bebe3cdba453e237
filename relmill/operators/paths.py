"""Paths, not only distances: reconstruction from predecessors, all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.operators.analytics import shortest_paths
from relmill.staging import Scratch


def paths(found: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(source, target, path): the vertices from a source to a target, both included.

    found: (source, id, pred) of bfs_levels or shortest_paths. wanted: (source, target), all of ``found`` if not
    given. Pairs without a path are absent. All paths step back by one vertex a round.
    """
    scratch = Scratch(found.sparkSession, merge=True)
    steps = scratch.store(found.select("source", F.col("id").alias("node"), "pred"), "steps")
    pairs = steps.select("source", F.col("node").alias("target")) if wanted is None else wanted.select("source", "target").distinct()
    now = pairs.select("source", "target", F.col("target").alias("node"), F.array(F.col("target").cast("long")).alias("path"))
    done = None
    while True:
        at = scratch.store(now.join(steps, ["source", "node"]), "at")
        ended = at.where("pred is null").select("source", "target", "path")
        done = ended if done is None else done.unionByName(ended)
        now = at.where("pred is not null").select("source", "target", F.col("pred").alias("node"), F.concat(F.array("pred"), "path").alias("path"))
        if not now.take(1):
            return done


def all_pairs(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """(source, id, distance) of every pair that a path joins, a vertex and itself included."""
    return shortest_paths(edges, vertices.select("id"), directed).select("source", "id", "distance")


def predecessors(found: DataFrame, edges: DataFrame, weight: str = "weight", directed: bool = False) -> DataFrame:
    """(source, id, distance, pred) of least distances (source, id, distance): the smallest vertex that a least path may
    come from, whatever the order in which the distances were found. Weights must be positive."""
    pairs = edges.select("src", "dst", F.col(weight).alias("w"))
    if not directed:
        pairs = pairs.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(weight).alias("w")))
    pairs = pairs.groupBy("src", "dst").agg(F.min("w").alias("w"))
    before = found.select("source", F.col("id").alias("src"), F.col("distance").alias("_d")).join(pairs, "src")
    best = before.select("source", F.col("dst").alias("id"), "src", (F.col("_d") + F.col("w")).alias("_to")).join(found.select("source", "id", "distance"), ["source", "id"])
    best = best.where(F.abs(F.col("_to") - F.col("distance")) <= 1e-12 * F.abs("distance")).groupBy("source", "id").agg(F.min("src").alias("pred"))
    return found.select("source", "id", "distance").join(best, ["source", "id"], "left").select("source", "id", "distance", F.when(F.col("source") != F.col("id"), F.col("pred")).alias("pred"))


def nearest_source(edges: DataFrame, sources: DataFrame, weight: str | None = None, directed: bool = False, compact: int = 8) -> DataFrame:
    """(id, distance) to the nearest of all sources: hops, or the sum of a column of weights that are not negative.

    All sources start one frontier at 0, so a vertex has one row however many they are. A round stores only the vertices that
    came nearer; every ``compact`` rounds the layers become one table and the old ones go.
    """
    scratch = Scratch(edges.sparkSession, merge=True)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pairs = edges.select("src", "dst", w.alias("w"))
    if not directed:
        pairs = pairs.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w")))
    pairs = scratch.store(pairs.where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "pairs")
    fresh = scratch.store(sources.select("id", F.lit(0.0).alias("distance")).where("id is not null").distinct(), "layer")
    layers = [fresh]
    known = lambda: layers[0] if len(layers) == 1 else reduce(DataFrame.unionByName, layers).groupBy("id").agg(F.min("distance").alias("distance"))
    while True:
        offer = fresh.withColumnRenamed("id", "src").join(pairs, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("w")).alias("_d"))
        better = offer.join(scratch.shuffled(known()), "id", "left").where(F.col("distance").isNull() | (F.col("_d") < F.col("distance")))
        fresh = scratch.store(better.select("id", F.col("_d").alias("distance")), "layer")
        if not fresh.take(1):
            return known()
        layers.append(fresh)
        if len(layers) > compact:
            whole = scratch.store(known(), "known")
            for old in layers[:-1]:
                scratch.drop(old)
            layers = [whole]
