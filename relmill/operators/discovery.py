"""Keys and relations of undeclared tables, from their values.

All columns' distinct values meet in one shuffle, by value. A value with its set of columns says that each of them holds
what the others hold there; a column is included in another if they hold every one of its values together (De Marchi et
al., 2009, as in distributed inclusion search). Sets are counted before pairs are made, so pairs come from the few
distinct sets, never from values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegralType, StringType

from relmill.schema import ForeignKey, RelationalDB
from relmill.staging import Scratch


def _class(kind) -> str | None:
    """Columns of one class can refer to each other; others, such as fractions and times, are no keys."""
    if isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale == 0):
        return "i"
    return "s" if isinstance(kind, StringType) else "d" if isinstance(kind, DateType) else None


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(class, value, table, column, n): the distinct values of every column that could be a key, with their number
    of rows. A value longer than a digest stands by its digest."""
    out = []
    for name, df in tables.items():
        cols = [(f.name, _class(f.dataType)) for f in df.schema.fields if not isinstance(f.dataType, BooleanType) and _class(f.dataType)]
        if not cols:
            continue
        value = lambda c: F.when(F.length(F.col(c).cast("string")) > 64, F.sha2(F.col(c).cast("string"), 256)).otherwise(F.col(c).cast("string"))
        entry = [F.struct(F.lit(k).alias("class"), value(c).alias("value"), F.lit(name).alias("table"), F.lit(c).alias("column")) for c, k in cols]
        out.append(df.select(F.explode(F.array(*entry)).alias("e")).select("e.*").groupBy("class", "value", "table", "column").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, out)


def column_profile(values: DataFrame) -> DataFrame:
    """(table, column, n_distinct, n_null, is_key) of column_values: a key has no null and no value twice."""
    known = F.col("value").isNotNull()
    rows = values.groupBy("table", "column").agg(F.count_if(known).alias("n_distinct"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"), F.max(F.when(known, F.col("n"))).alias("_most"))
    return rows.select("table", "column", "n_distinct", "n_null", ((F.col("n_null") == 0) & F.coalesce(F.col("_most") == 1, F.lit(False))).alias("is_key"))


def inclusions(values: DataFrame, scratch: Scratch) -> DataFrame:
    """(table, column, target, target_column, n_values, coverage): each column whose values are all in another table's
    key column, with the share of the key's values that it uses. Columns without a value are left out."""
    profile = scratch.store(column_profile(values), "profile")  # a row per column
    name = F.struct("table", "column")
    sets = values.where("value is not null").groupBy("class", "value").agg(F.array_sort(F.collect_set(name)).alias("s"))  # at most all columns
    sets = sets.groupBy("s").agg(F.count("*").alias("n"))
    pairs = sets.select(F.explode("s").alias("a"), "s", "n").select("a", F.explode("s").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("both"))
    own = profile.select(F.col("table").alias("_t"), F.col("column").alias("_c"), F.col("n_distinct").alias("n_values"))
    keys = profile.where("is_key").select(F.col("table").alias("target"), F.col("column").alias("target_column"), F.col("n_distinct").alias("_all"))
    found = pairs.select(F.col("a.table").alias("table"), F.col("a.column").alias("column"), F.col("b.table").alias("target"), F.col("b.column").alias("target_column"), "both").where("table <> target")
    found = found.join(own, (F.col("table") == F.col("_t")) & (F.col("column") == F.col("_c"))).where("both = n_values").join(keys, ["target", "target_column"])
    return found.select("table", "column", "target", "target_column", "n_values", (F.col("n_values") / F.col("_all")).alias("coverage"))


def alike(column: str, key: str) -> bool:
    """Whether a column's name is that of a key, or both are after a table's prefix, such as o_custkey and c_custkey;
    a mere id says nothing of its table."""
    stem = lambda c: c.lower().split("_", 1)[-1]
    return key.lower() in (column.lower(), stem(column)) or stem(column) == stem(key) != "id"


def discover(name: str, tables: dict[str, DataFrame], times: dict[str, str] | None = None) -> RelationalDB:
    """A database with keys and foreign keys from the tables' values: of a table's keys the first by column order; of
    the inclusions into them those whose names end alike, one per column, the best covered. The rest of
    ``inclusions`` is for a person to judge: small integers are included in many keys by accident."""
    scratch = Scratch(next(iter(tables.values())).sparkSession)
    values = scratch.store(column_values(tables), "values")
    key = {(r.table, r.column) for r in column_profile(values).where("is_key").collect()}  # a row per column
    keys = {n: next(c for c in df.columns if (n, c) in key) for n, df in tables.items() if any((n, c) in key for c in df.columns)}
    found = [r for r in inclusions(values, scratch).collect() if alike(r.column, r.target_column)]  # pairs of columns
    best = {}
    for r in sorted(found, key=lambda r: (-r.coverage, r.target)):
        if keys.get(r.target) == r.target_column:
            best.setdefault((r.table, r.column), ForeignKey(r.table, r.column, r.target))
    order = {(n, c): i for i, (n, c) in enumerate((n, c) for n, df in tables.items() for c in df.columns)}
    return RelationalDB(name, tables, [best[k] for k in sorted(best, key=order.get)], keys, times or {})
