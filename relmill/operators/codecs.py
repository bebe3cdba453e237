"""Delta, run-length and quantising codecs over an ordered column, within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relmill.functions.scalars import dequantised, quantised


def delta_encode(df: DataFrame, by: str, order: str, column: str, out: str = "delta") -> DataFrame:
    """Differences to the row before; the first row keeps its value."""
    return df.withColumn(out, F.col(column) - F.coalesce(F.lag(column).over(Window.partitionBy(by).orderBy(order)), F.lit(0)))


def delta_decode(df: DataFrame, by: str, order: str, column: str = "delta", out: str = "value") -> DataFrame:
    return df.withColumn(out, F.sum(column).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def run_length_encode(df: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """(by, run, value, length): runs of equal values, null equal to null."""
    w = Window.partitionBy(by).orderBy(order)
    first = F.row_number().over(w) == 1
    new = F.when(first | ~F.lag(column).over(w).eqNullSafe(F.col(column)), 1).otherwise(0)
    rows = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "run").agg(F.first(column).alias("value"), F.count("*").alias("length"))


def run_length_decode(runs: DataFrame, by: str) -> DataFrame:
    """(by, run, place, value), one row per original value."""
    return runs.select(by, "run", F.explode(F.sequence(F.lit(1), F.col("length").cast("int"))).alias("place"), "value")


def quantise(df: DataFrame, column: str, bits: int) -> DataFrame:
    """Adds code and restored: the column in 2^bits steps of its range."""
    both = df.crossJoin(F.broadcast(df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))))
    both = both.withColumn("code", quantised(F.col(column), F.col("_a"), F.col("_b"), bits))
    return both.withColumn("restored", dequantised(F.col("code"), F.col("_a"), F.col("_b"), bits)).drop("_a", "_b")
