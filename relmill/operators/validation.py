"""Data validation: rules as predicates, all counted in one pass over the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"

#: Each gives, for a column, whether a value breaks the rule. Null breaks not_null alone.
RULES: dict[str, Callable[..., Column]] = {
    "not_null": lambda c: c.isNull() | c.cast("string").isin("", "null", "NULL"),
    "positive": lambda c: c <= 0,
    "non_negative": lambda c: c < 0,
    "range": lambda c, low, high: c.isNotNull() & ~F.coalesce(c.cast("string").try_cast("double").between(low, high), F.lit(False)),
    "pattern": lambda c, regex: ~c.cast("string").rlike(regex),
    "email": lambda c: ~c.rlike(EMAIL),
    "uuid": lambda c: ~c.rlike(UUID),
    "json": lambda c: c.isNotNull() & F.try_parse_json(c).isNull(),
    "timestamp": lambda c: c.isNotNull() & ~(c.rlike(RFC3339) & F.try_to_timestamp(F.substring(F.translate(c, "Tt", "  "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()),
}


def validate(df: DataFrame, table: str, rules: list[tuple]) -> DataFrame:
    """(table, column, rule, rows, violations) for rules (column, name, *arguments), (column, "unique") or
    (name, "custom", predicate that a good row fulfils). An empty table has no violations."""
    aggs, names = [F.count("*").alias("_rows")], []
    for i, (column, rule, *args) in enumerate(rules):
        if rule != "custom" and column not in df.columns:
            raise ValueError(f"{table} has no column {column}")
        c = F.col(column) if rule != "custom" else None
        if rule == "unique":  # null is one more value
            bad = F.count("*") - F.count_distinct(c) - F.max(F.when(c.isNull(), 1).otherwise(0))
        else:
            broken = ~args[0] if rule == "custom" else RULES[rule](c, *args)
            bad = F.sum(F.when(F.coalesce(broken, F.lit(False)), 1).otherwise(0))
        aggs.append(F.coalesce(bad, F.lit(0)).cast("long").alias(f"_v{i}"))
        names.append((column, rule))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"_v{i}").alias("violations")) for i, (c, r) in enumerate(names)]
    return df.agg(*aggs).select(F.lit(table).alias("table"), F.explode(F.array(*rows)).alias("x"), F.col("_rows").alias("rows")).select("table", "x.column", "x.rule", "rows", "x.violations")


def foreign_key_report(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """(table, column, target, rows, orphans) for keys (table, column, target, target's key)."""
    out = None
    for table, column, target, key in keys:
        ids = tables[target].select(F.col(key).alias("_k"), F.lit(1).alias("_hit")).distinct()
        rows = tables[table].select(F.col(column).alias("_k")).join(ids, "_k", "left")
        bad = F.sum(F.when(F.col("_k").isNotNull() & F.col("_hit").isNull(), 1).otherwise(0))
        row = rows.agg(F.count("*").alias("rows"), F.coalesce(bad, F.lit(0)).cast("long").alias("orphans")).select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(target).alias("target"), "rows", "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def suggestions(sizes: DataFrame, accesses: DataFrame, index_over: int = 1_000, partition_over: int = 100_000) -> DataFrame:
    """(table, suggestion) from (table, rows) and (table, accesses)."""
    both = sizes.join(accesses, "table", "left")
    items = F.filter(F.array(F.when(F.col("accesses") > index_over, F.lit("index")), F.when(F.col("rows") > partition_over, F.lit("partition"))), lambda x: x.isNotNull())
    return both.select("table", F.explode(items).alias("suggestion"))


def missing_tables(tables, required: list[str]) -> list[str]:
    return sorted(set(required) - set(tables))


def require(tables, required: list[str]) -> None:
    """Raises if a required table is missing."""
    if missing := missing_tables(tables, required):
        raise ValueError(f"missing tables: {', '.join(missing)}")


def check_dataset(name: str, description: str, version: str, tables: dict, valid_from: str, test_from: str) -> list[str]:
    """What is wrong with a dataset's declaration: an empty name, description, version or set of tables, or a test
    time that is not after the validation time."""
    out = [f"{k} is empty" for k, v in (("name", name), ("description", description), ("version", version), ("tables", tables)) if not v]
    return out + ([] if test_from > valid_from else ["the test time is not after the validation time"])


def require_rows(df: DataFrame, table: str, columns: list[str]) -> None:
    """Raises, in this order, on an empty table and on a column that is missing."""
    if not df.take(1):
        raise ValueError(f"{table} is empty")
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"{table} has no column {c}")


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nan, infinite): how many values of each column are no finite number."""
    nan = [F.sum(F.when(F.isnan(F.col(c).cast("double")), 1).otherwise(0)) for c in columns]
    inf = [F.sum(F.when(F.abs(F.col(c).cast("double")) == float("inf"), 1).otherwise(0)) for c in columns]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nan"), F.col(f"_i{i}").alias("infinite")) for i, c in enumerate(columns)]
    one = df.agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(f"_n{i}") for i, x in enumerate(nan)], *[F.coalesce(x, F.lit(0)).cast("long").alias(f"_i{i}") for i, x in enumerate(inf)])
    return one.select(F.inline(F.array(*rows)))
