"""Distances of whole graphs by mergeable sketches: how many nodes each node reaches within every number of hops.

A node's sketch after r hops is the union of its own and its targets' sketches after r - 1 (HyperBall, Boldi and Vigna,
2013). A round moves one sketch of bounded size along each edge and merges map-side, so the work is rounds x edges where exact
distances need a row per pair. Sketches that do not grow any more are not sent again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmill.staging import Scratch


def neighbourhoods(vertices: DataFrame, edges: DataFrame, precision: int = 12, hops: int | None = None) -> DataFrame:
    """(id, hop, reached): an estimate of the number of nodes within ``hop`` steps, itself included, for every hop at
    which it grows; hop 0 is one. The error is about 1.04 / sqrt(2^precision); small sets are exact. Without ``hops`` it runs
    until nothing grows. Edges from or to other vertices are left out; repeated vertices count once."""
    scratch = Scratch(edges.sparkSession, merge=True)
    ids = scratch.store(vertices.select("id").where("id is not null").distinct(), "vertices")
    ends = edges.select("src", "dst").where("src <> dst").distinct()
    ends = ends.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = scratch.store(ends, "edges")
    now = scratch.store(ids.groupBy("id").agg(F.hll_sketch_agg("id", precision).alias("s")).select("id", "s", F.lit(1).cast("long").alias("n"), F.lit(True).alias("grown")), "sketches")
    out, hop = [now.select("id", F.lit(0).alias("hop"), F.col("n").alias("reached"))], 0
    while hops is None or hop < hops:
        hop += 1
        fresh = now.where("grown").select(F.col("id").alias("dst"), "s")
        got = ends.join(fresh, "dst").select(F.col("src").alias("id"), "s").unionByName(now.select("id", "s"))
        merged = scratch.store(got.groupBy("id").agg(F.hll_union_agg("s").alias("s")), "merged")
        new = merged.join(now.select("id", "n"), "id").withColumn("_e", F.hll_sketch_estimate("s"))
        new = scratch.store(new.select("id", "s", F.greatest("_e", "n").alias("n"), (F.col("_e") > F.col("n")).alias("grown")), "sketches")
        scratch.drop(merged)
        scratch.drop(now)
        now = new
        step = scratch.store(now.where("grown").select("id", F.lit(hop).alias("hop"), F.col("n").alias("reached")), "reached")
        if not step.take(1):
            break
        out.append(step)
    first = scratch.store(ids.select("id", F.lit(0).alias("hop"), F.lit(1).cast("long").alias("reached")), "reached")
    rows = first
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def sketched_closeness(vertices: DataFrame, edges: DataFrame, precision: int = 12) -> DataFrame:
    """(id, reached, distance, closeness, harmonic): others reached, the sum of distances to them, their ratio, and the
    sum of inverse distances; zeros for a node that reaches none."""
    from pyspark.sql import Window

    grown = neighbourhoods(vertices, edges, precision)
    more = F.col("reached") - F.coalesce(F.lag("reached").over(Window.partitionBy("id").orderBy("hop")), F.col("reached"))
    rows = grown.withColumn("more", more).groupBy("id").agg(F.sum("more").alias("reached"), F.sum(F.col("hop") * F.col("more")).alias("distance"), F.sum(F.when(F.col("hop") > 0, F.col("more") / F.col("hop")).otherwise(0.0)).alias("harmonic"))
    return rows.select("id", "reached", "distance", F.when(F.col("distance") > 0, F.col("reached") / F.col("distance")).otherwise(0.0).alias("closeness"), "harmonic")
