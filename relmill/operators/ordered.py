"""Order-dependent operators without a one-partition sort: range partitions plus per-partition offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmill.staging import Scratch


def _parted(df: DataFrame, order: list) -> tuple[DataFrame, Scratch]:
    """df, sorted by range over partitions; the partition's number is stored with the rows, so it can't shift."""
    scratch = Scratch(df.sparkSession)
    return scratch.store(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"), scratch


def row_index(df: DataFrame, order: list, name: str = "_row") -> DataFrame:
    """Adds the 0-based position in a total ``order``. Rows that tie on all of it are told apart arbitrarily."""
    parts, _ = _parted(df, order)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))  # a row per partition
    rows = parts.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + F.col("_rn") - 1).cast("long")).drop("_part", "_offset", "_rn")


def page_rows(df: DataFrame, order: list, offset: int, n: int) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` of a total ``order``: the partitions that hold them are sorted, the others only
    counted."""
    parts, _ = _parted(df, order)
    begin, here = 0, []
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row per partition
        if begin < offset + n and begin + r.n > offset:
            here.append((r["_part"], begin))
        begin += r.n
    if not here:
        return df.limit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    first = F.create_map(*[F.lit(x) for pair in here for x in pair])
    rows = parts.where(F.col("_part").isin([p for p, _ in here])).withColumn("_row", place + first[F.col("_part")])
    return rows.where((F.col("_row") >= offset) & (F.col("_row") < offset + n)).drop("_part", "_row")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of a column over all rows up to and with this one, in ``order``."""
    parts, _ = _parted(df.withColumns({f"_v_{k}": v for k, v in sums.items()}), order)
    totals = parts.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(w), F.lit(0)).alias(f"_o_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumns({k: F.sum(f"_v_{k}").over(own) for k in sums}).join(F.broadcast(offsets), "_part")
    rows = rows.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums})
    return rows.drop("_part", *[f"{p}{k}" for k in sums for p in ("_v_", "_o_")])


def nearest_rank(df: DataFrame, column: str, q: float) -> DataFrame:
    """The value at position round((n - 1) q) of the sorted non-null values; no row for an empty table."""
    values = row_index(df.where(F.col(column).isNotNull()).select(column), [column])
    n = values.agg((F.count("*") - 1).alias("_last"))
    return values.crossJoin(F.broadcast(n)).where(F.col("_row") == F.round(F.col("_last") * F.lit(float(q))).cast("long")).select(column)
