"""Label tables over future time windows, and splits without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_table(
    entities: DataFrame, key: str, facts: DataFrame, fact_key: str, time: Column, seeds: list[str], horizon_days: int, amount: Column | None = None, scale: int = 2
) -> DataFrame:
    """(seed, key, n_events, total, churn) for each entity and seed time, from facts in (seed, seed + horizon].

    The facts are cut to the windows before the shuffle and aggregated per entity, so the join sees one row
    per entity and seed. Amounts are added as decimals, which do not depend on the order of rows.
    """
    ts = [F.lit(s).cast("timestamp_ntz") for s in seeds]
    rows = facts.select(F.col(fact_key).alias(key), time.cast("timestamp_ntz").alias("_t"), (F.lit(0) if amount is None else amount).cast(f"decimal(18,{scale})").alias("_a"))
    end = F.col("seed") + F.expr(f"interval {int(horizon_days)} days")
    inside = rows.withColumn("seed", F.explode(F.array(*ts))).where((F.col("_t") > F.col("seed")) & (F.col("_t") <= end))
    per = inside.groupBy("seed", key).agg(F.count("*").alias("n_events"), F.sum("_a").alias("total"))
    grid = entities.select(key).withColumn("seed", F.explode(F.array(*ts)))
    n = F.coalesce("n_events", F.lit(0)).cast("long")
    return grid.join(per, ["seed", key], "left").select("seed", key, n.alias("n_events"), F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), F.when(n == 0, 1).otherwise(0).alias("churn"))


def hash_split(df: DataFrame, key: str, seed: int = 0, train: float = 0.6, valid: float = 0.2, name: str = "split") -> DataFrame:
    """train, valid or test by a digest of the key: the same entity always lands in the same part."""
    # 28 bits of an MD5, which SQL engines agree on
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 7), 16, 10).cast("long") / float(16**7)
    return df.withColumn(name, F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def temporal_split(df: DataFrame, time: str, valid_from: str, test_from: str, name: str = "split") -> DataFrame:
    """train up to the first time, valid up to the second, test after it; rows without a time are train."""
    t = F.col(time).cast("timestamp_ntz")
    v, s = F.lit(valid_from).cast("timestamp_ntz"), F.lit(test_from).cast("timestamp_ntz")
    return df.withColumn(name, F.when(t > s, "test").when(t > v, "valid").otherwise("train"))


def label_stats(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Mean and population deviation of the label over the training part alone."""
    return df.where(F.col(split) == "train").agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("std"))


def dropped_edges(edges: DataFrame, share: float, seed: int) -> DataFrame:
    """Edge dropout: a hash of the edge and the seed decides, so a repeated run drops the same edges."""
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("src", "dst", "etype")], F.lit(str(seed))))
    return edges.where(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") / float(16**7) >= share)


def noisy(features: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Adds normal noise to each component (Box-Muller over digests of node, place and seed)."""

    def u(i, at):
        digest = F.md5(F.concat_ws(":", F.col("node_id").cast("string"), i.cast("string"), F.lit(str(seed))))
        return (F.conv(F.substring(digest, at, 7), 16, 10).cast("long") + 0.5) / float(16**7)

    noise = lambda i: F.sqrt(-2.0 * F.log(u(i, 1))) * F.cos(F.lit(6.283185307179586) * u(i, 8))
    return features.withColumn("x", F.transform("x", lambda v, i: v + noise(i) * sigma))


def mini_batches(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A batch number for each row, of ``size`` rows each, in hashed order."""
    from relmill.operators.ordered import row_index

    order = row_index(df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))), ["_h", key], "_i")
    return order.withColumn("batch", F.floor(F.col("_i") / size)).drop("_h", "_i")


def stratified_sample(df: DataFrame, key: str, stratum: str, share: float, seed: int = 42) -> DataFrame:
    """The first ``share`` of each stratum's rows, at least one, in order of a digest of key and seed."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") / float(16**7)
    least = df.groupBy(stratum).agg(F.min_by(key, F.struct(digest, F.col(key))).alias("_first"))
    rows = df.join(least, stratum)
    return rows.where((u < share) | (F.col(key) == F.col("_first"))).drop("_first")


def poisson(rate: Column, u: Column, most: int = 10_000) -> Column:
    """A Poisson draw by inversion of a uniform draw: how many terms of the distribution lie below it; 0 for rate <= 0."""
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"]).alias("c"), (s["n"] + (s["c"] + s["p"] <= u).cast("int")).alias("n"))
    terms = F.sequence(F.lit(1), F.least(F.lit(most), F.ceil(rate + 12 * F.sqrt(F.greatest(rate, F.lit(1.0))) + 12)).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.lit(0.0).alias("c"), F.lit(0).alias("n"))
    return F.when(rate > 0, F.aggregate(terms, start, step)["n"]).otherwise(0)


def time_span(tables: dict[str, DataFrame], times: dict[str, str]) -> DataFrame:
    """(first, last): the earliest and the latest event time over all tables that have one."""
    out = None
    for name, column in times.items():
        part = tables[name].agg(F.min(column).alias("a"), F.max(column).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out.agg(F.min("a").alias("first"), F.max("b").alias("last"))
