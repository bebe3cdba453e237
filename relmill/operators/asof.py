"""As-of joins: for every (key, time) the last version known by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relmill.staging import Scratch


def asof_join(seeds: DataFrame, versions: DataFrame, keys: list[str], time: str, values: list[str], order: list[str] = (), strict: bool = False) -> DataFrame:
    """Every row of ``seeds`` once, with the ``values`` of the last version of its key whose time is not after its own
    (with ``strict``: is before it); null where there is none.

    Both tables have the columns ``keys`` and ``time``. Of versions at one time the last by ``order``, then by the values,
    counts. Versions with a null key or time are left out, seeds with one get nulls; repeated seeds stay repeated. The
    values' names must not be columns of ``seeds``.

    Both tables are laid end to end and split by ranges of (key, time), so a hot key is dealt over slices of time and a
    version meets its seeds without a join: inside a slice the last version is carried along. A slice's first key takes
    what the slices before it have carried, from a table of two rows a slice.
    """
    clash = [c for c in values if c in seeds.columns]
    if clash:
        raise ValueError(f"columns of both tables: {clash}")
    scratch = Scratch(seeds.sparkSession)
    key = [f"_k{i}" for i in range(len(keys))]
    named = lambda df: [F.col(c).alias(k) for c, k in zip(keys, key, strict=True)] + [F.col(time).alias("_t")]
    v = versions.select(*named(versions), F.lit(1 if strict else 0).alias("_kind"), F.struct(*order, *values).alias("_rank"), F.struct(*values).alias("_v")).dropna(subset=[*key, "_t"])
    s = seeds.select(*named(seeds), F.lit(0 if strict else 1).alias("_kind"), F.struct(*seeds.columns).alias("_s"))
    rows = v.unionByName(s, allowMissingColumns=True).repartitionByRange(*key, "_t").withColumn("_part", F.spark_partition_id())
    rows = scratch.store(rows, "slices")
    here = Window.partitionBy("_part", *key).orderBy("_t", "_kind", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(here))
    # what a slice hands on: the last version of its last key
    ends = rows.groupBy("_part").agg(F.min(F.struct(*key)).alias("_first"), F.max(F.struct(*key)).alias("_last"))
    lasts = rows.groupBy("_part", *key).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_rank"))).alias("_v"))
    tails = ends.join(lasts, "_part").where(F.struct(*key) == F.col("_last")).select("_part", F.lit(1).alias("_end"), *key, "_v")
    heads = ends.select("_part", F.lit(0).alias("_end"), *[F.col(f"_first.{k}").alias(k) for k in key], F.lit(None).cast(lasts.schema["_v"].dataType).alias("_v"))
    before = Window.partitionBy(*key).orderBy("_part", "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = heads.unionByName(tails).withColumn("_carry", F.last("_v", ignorenulls=True).over(before)).where("_end = 0 and _carry is not null")
    carry = scratch.store(carry.select("_part", *key, "_carry"), "carried")  # at most a row a slice
    out = carried.where("_s is not null").join(F.broadcast(carry), ["_part", *key], "left")
    known = F.coalesce("_own", "_carry")
    return out.select("_s.*", *[known[c].alias(c) for c in values])
