"""Column encoders: scaling, dictionaries. Statistics come from one aggregate, broadcast as a single row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _with_stats(df: DataFrame, *aggs) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*aggs)))  # one row


def standardise(df: DataFrame, column: str, out: str, sample: bool = False, floor: float = 1e-6) -> DataFrame:
    """(x - mean) / std with the population (or sample) deviation, at least ``floor``."""
    std = F.stddev_samp(column) if sample else F.stddev_pop(column)
    both = _with_stats(df, F.avg(column).alias("_m"), std.alias("_s"))
    return both.withColumn(out, (F.col(column) - F.col("_m")) / F.greatest("_s", F.lit(floor))).drop("_m", "_s")


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """To [0, 1]; a constant column gives 0."""
    both = _with_stats(df, F.min(column).alias("_a"), F.max(column).alias("_b"))
    return both.withColumn(out, F.when(F.col("_b") > F.col("_a"), (F.col(column) - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)).drop("_a", "_b")


def robust(df: DataFrame, column: str, out: str) -> DataFrame:
    """(x - median) / (upper - lower quartile), interpolated; without a spread, x - median. The quartiles are read off
    positions in a range-partitioned order, whatever the number of distinct values."""
    from relmill.operators.ordered import row_index

    at = row_index(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x")), ["_x"])
    last = at.agg((F.count("*") - 1).cast("double").alias("_l"))
    place = lambda q: F.col("_l") * F.lit(q)
    share = lambda q: F.greatest(F.lit(0.0), 1 - F.abs(F.col("_row") - place(q)))  # noqa: E731  linear between two positions
    stats = at.crossJoin(F.broadcast(last)).agg(*[F.sum(F.when(share(q) > 0, share(q) * F.col("_x"))).alias(n) for q, n in ((0.25, "_a"), (0.5, "_m"), (0.75, "_b"))])
    both = df.crossJoin(F.broadcast(stats))
    spread = F.when(F.col("_b") > F.col("_a"), F.col("_b") - F.col("_a")).otherwise(1.0)
    return both.withColumn(out, (F.col(column) - F.col("_m")) / spread).drop("_a", "_m", "_b")


def dictionary(df: DataFrame, column: str, row: str) -> DataFrame:
    """(value, code): codes from 0 in order of first appearance by ``row``; null and empty are values too."""
    first = df.groupBy(F.col(column).alias("value")).agg(F.min(row).alias("first_row"))
    from relmill.operators.ordered import row_index

    return row_index(first, ["first_row"], "code")


def dictionary_encoded(df: DataFrame, column: str, row: str, out: str) -> DataFrame:
    codes = dictionary(df, column, row).select("value", F.col("code").alias(out))
    return df.join(codes, F.col(column).eqNullSafe(F.col("value")), "left").drop("value")


def vocabulary(df: DataFrame, column: str, first_id: int = 0) -> DataFrame:
    """(token, id): distinct values in alphabetical order, from ``first_id`` on."""
    from relmill.operators.ordered import row_index

    tokens = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("token")).distinct()
    return row_index(tokens, ["token"], "id").withColumn("id", F.col("id") + first_id)


def embedding_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation over all components of all vectors."""
    return df.select(F.explode(column).alias("x")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def lagged(df: DataFrame, by: str, order: str, column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(column).over(Window.partitionBy(by).orderBy(order)))


def feature_columns(db, table: str) -> list[str]:
    """The columns of a table that describe its rows: no keys, no foreign keys, no event time."""
    keys = {db.keys.get(table), db.times.get(table), *[k.column for k in db.foreign_keys if k.table == table]}
    return [c for c in db.tables[table].columns if c not in keys]


def encoded_rows(db, table: str, categories: dict[str, int] | None = None, t_max: float | None = None) -> DataFrame:
    """(key, x) of a table's rows: standardised numbers, one-hot categories and cyclic times side by side.

    categories: the number of codes of each categorical column, whose values are whole numbers from 0. Missing numbers
    and codes that are out of range give zeros. ``t_max`` adds the relative event time and its sines and cosines.
    """
    from relmill.functions.scalars import cyclic_time

    categories = categories or {}
    df, key = db.tables[table], db.keys[table]
    numbers = [c for c, t in df.dtypes if c in feature_columns(db, table) and c not in categories and t in ("int", "bigint", "float", "double", "smallint", "tinyint")]
    if numbers:
        df = df.crossJoin(F.broadcast(df.agg(*[f(c).alias(f"_{n}_{c}") for c in numbers for n, f in (("m", F.avg), ("s", F.stddev_pop))])))
    x = [F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-6)), F.lit(0.0)) for c in numbers]
    x += [F.coalesce((F.col(c) == i).cast("double"), F.lit(0.0)) for c, n in categories.items() for i in range(n)]
    if t_max is not None and table in db.times:
        x += list(cyclic_time(F.col(db.times[table]).cast("double"), F.lit(float(t_max))).values())
    return df.select(F.col(key).alias("key"), F.array(*[c.cast("double") for c in x]).alias("x"))


def sparse_weights(df: DataFrame, by: str, order: str, share: float) -> DataFrame:
    """Magnitude pruning: the rows of the largest (1 - share) of |by|, ties by ``order``; all if ``share`` is 0."""
    from relmill.operators.ordered import row_index

    keep = int((1 - share) * df.count() + 1e-9)
    return row_index(df.withColumn("_size", F.abs(by)), [F.col("_size").desc(), F.col(order)]).where(F.col("_row") < keep).drop("_row", "_size")


def page(df: DataFrame, order: list, offset: int, n: int) -> DataFrame:
    """Rows ``offset`` to ``offset + n`` of a total order. An early page comes from the first rows of each task; for a late
    one, range partitions are counted and only the one or two that hold it are numbered."""
    from relmill.operators.ordered import page_rows

    return df.orderBy(*order).offset(offset).limit(n) if offset + n <= 10_000 else page_rows(df, order, offset, n)
