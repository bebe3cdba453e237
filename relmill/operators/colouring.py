"""Colouring of the vertices of a graph in order of a priority (Jones and Plassmann, 1993)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.operators.analytics import simple_pairs
from relmill.staging import Scratch


def priority_colouring(vertices: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """(id, colour) of greedy colouring by falling degree, ties by a digest of the id: at most one colour more than the
    largest degree.

    A round colours every vertex that waits for no neighbour of higher priority, with the smallest colour that none of those
    has. As ties are broken by digests, rounds follow the logarithm of the number of vertices and not the longest path.
    Only edges between waiting vertices are read again. Loops, parallel edges and edges of other vertices are left out.
    """
    scratch = Scratch(edges.sparkSession, merge=True)
    ids = scratch.store(vertices.select("id").where("id is not null").distinct(), "vertices")
    pairs = simple_pairs(edges).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    pairs = scratch.store(pairs, "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    rank = scratch.store(ids.join(degree, "id", "left").select("id", F.struct(F.coalesce("degree", F.lit(0)).alias("d"), digest.alias("h"), "id").alias("r")), "ranks")
    both = pairs.join(rank.toDF("a", "ra"), "a").join(rank.toDF("b", "rb"), "b")
    first = F.col("ra") > F.col("rb")
    waits = scratch.store(both.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("on")), "waits")
    left, used, done = ids, None, []
    while True:
        ready = left.join(waits.select("id").distinct(), "id", "left_anti")
        if used is None:
            ready = ready.select("id", F.lit(0).alias("colour"))
        else:
            taken = used.groupBy("id").agg(F.collect_set("colour").alias("taken"))  # no more than the colours in use
            ready = ready.join(taken, "id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
            ready = ready.select("id", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken")).alias("colour"))
        ready = scratch.store(ready, "coloured")
        if not ready.take(1):
            break
        done.append(ready)
        told = waits.join(ready.select(F.col("id").alias("on"), "colour"), "on").select("id", "colour")
        told = told if used is None else told.unionByName(used.join(ready.select("id"), "id", "left_anti"))
        new_used = scratch.store(told.distinct(), "used")
        new_waits = scratch.store(waits.join(ready.select(F.col("id").alias("on")), "on", "left_anti").select("id", "on"), "waits")
        new_left = scratch.store(left.join(ready.select("id"), "id", "left_anti"), "left")
        for old in (used, waits, left):
            scratch.drop(old)
        left, used, waits = new_left, new_used, new_waits
    return reduce(DataFrame.unionByName, done) if done else ids.select("id", F.lit(0).alias("colour"))
