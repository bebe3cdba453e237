"""Databases on disk: CSV with a schema file, Parquet folders, JDBC, and the bundled synthetic shop."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmill.functions.features import dictionary_encoded
from relmill.functions.scalars import NEVER, number_or_zero, parse_time
from relmill.operators.ordered import row_index
from relmill.schema import DatabaseSpec, ForeignKey, RelationalDB, Role, TableSpec


def _text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one schema file
    return rows[0][0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def in_file_order() -> dict[str, Column]:
    """Columns whose order is that of the lines of a file or of a folder of parts: the part's number, the path, where the
    split begins, and the line in it. Spark deals files out by size, so row numbers over the whole scan are not in order."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
    return {"_number": number, "_path": F.col("_metadata.file_path"), "_begin": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}


def load_csv(spark: SparkSession, folder: str) -> tuple[RelationalDB, DatabaseSpec, DataFrame]:
    """The database in a folder with schema.json, its declaration, and the seed table's labels (_row, labels).

    Every cell is read as text and typed by its role: numbers (junk is 0), times (junk is -inf), categories as
    codes in order of first appearance. Ragged lines fail. A key that repeats means its last row. A foreign
    key becomes the row number that it names; one that names no row raises.
    """
    spec = DatabaseSpec.from_json(_text(spark, f"{folder}/schema.json"))
    raw, rows, keys = {}, {}, {}
    place = in_file_order()
    for t in spec.tables:
        df = spark.read.option("header", True).option("mode", "FAILFAST").csv(f"{folder}/{t.file or t.name + '.csv'}")
        missing = [c for c in t.roles if c not in df.columns]
        if missing:
            raise ValueError(f"{t.name}: no columns {missing}")
        raw[t.name] = row_index(df.withColumns(place), list(place)).drop(*place)
        if t.primary_key:
            keys[t.name] = raw[t.name].groupBy(F.col(t.primary_key).alias("_key")).agg(F.max("_row").alias("_target"))
    labels = None
    foreign = []
    for t in spec.tables:
        df, cols = raw[t.name], ["_row"]
        for c, role in t.roles.items():
            if role is Role.NUMERICAL:
                df = df.withColumn(c, number_or_zero(F.col(c)).cast("float"))
            elif role is Role.TIMESTAMP:
                df = df.withColumn(c, parse_time(F.col(c)))
            elif role is Role.CATEGORICAL:
                df = dictionary_encoded(df, c, "_row", f"_code_{c}").drop(c).withColumnRenamed(f"_code_{c}", c)
            elif role is Role.FOREIGN_KEY:
                target = t.targets[c]
                if target not in keys:
                    raise ValueError(f"{t.name}.{c}: {target} has no primary key")
                foreign.append(ForeignKey(t.name, c, target))
                df = df.join(keys[target], F.col(c) == F.col("_key"), "left").drop(c, "_key").withColumnRenamed("_target", c)
                if df.where(F.col(c).isNull()).take(1):
                    raise ValueError(f"{t.name}.{c}: a value names no row of {target}")
            if role not in (Role.PRIMARY_KEY, Role.IGNORE, Role.LABEL):
                cols.append(c)
        time = F.lit(NEVER) if t.time_column is None else (F.col(t.time_column) if t.roles.get(t.time_column) is Role.TIMESTAMP else parse_time(F.col(t.time_column)))
        df = df.withColumn("_time", time)
        if t.name == spec.seed_table:
            labels = df.select("_row", *[number_or_zero(F.col(c)).cast("float").alias(c) for c in t.columns(Role.LABEL)])
        rows[t.name] = df.select(*cols, "_time")
    return RelationalDB(folder.rstrip("/").rsplit("/", 1)[-1], rows, foreign, dict.fromkeys(rows, "_row"), dict.fromkeys(rows, "_time")), spec, labels


def save_csv(db: RelationalDB, spec: DatabaseSpec, folder: str, labels: DataFrame | None = None) -> None:
    """schema.json and a folder of CSV parts per table, with __id, the columns, __time and the seed's labels."""
    spark = next(iter(db.tables.values())).sparkSession
    out = []
    for t in spec.tables:
        df = db.tables[t.name]
        roles = {"__id": Role.PRIMARY_KEY} | {c: r for c, r in t.roles.items() if r not in (Role.PRIMARY_KEY, Role.IGNORE, Role.LABEL)} | {"__time": Role.TIMESTAMP}
        if t.name == spec.seed_table and labels is not None:
            df = df.join(labels, "_row")
            roles |= dict.fromkeys([c for c in labels.columns if c != "_row"], Role.LABEL)
        time = F.when(F.col("_time") > NEVER, F.col("_time"))
        cols = [F.col("_row").alias("__id"), time.alias("__time"), *[F.col(c) for c in roles if c not in ("__id", "__time")]]
        df.select(*cols).repartitionByRange("__id").sortWithinPartitions("__id").write.mode("overwrite").option("header", True).csv(f"{folder}/{t.name}.csv")
        out.append(TableSpec(t.name, roles, t.targets, "__time", f"{t.name}.csv"))
    write_text(spark, f"{folder}/schema.json", DatabaseSpec(out, spec.seed_table).to_json())


def save_parquet(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def load_parquet(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


READERS: dict[str, Callable] = {
    "parquet": lambda r, p: r.parquet(p),
    "csv": lambda r, p: r.option("header", True).csv(p),
    "json": lambda r, p: r.json(p),
    "orc": lambda r, p: r.orc(p),
}


def load_any(spark: SparkSession, path: str, kind: str | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """By the path's ending or ``kind``; with ``fraction`` a seeded random sample."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"unknown format: {kind}")
    df = READERS[kind](spark.read, path)
    return df if fraction is None else df.sample(fraction, seed=seed)


def load_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, timeout: int = 60, **options) -> DataFrame:
    """A table or query over JDBC; partition is (column, low, high, number) for parallel reads."""
    r = spark.read.format("jdbc").option("url", url).option("queryTimeout", timeout).options(**options)
    if partition:
        column, low, high, n = partition
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return (r.option("dbtable", table) if table else r.option("query", query)).load()


def schema_of(db: RelationalDB) -> DataFrame:
    """(table, position, column, type, is_key, target, is_time) of a database's tables."""
    spark = next(iter(db.tables.values())).sparkSession
    targets = {(k.table, k.column): k.target for k in db.foreign_keys}
    rows = [(n, i, c, kind, db.keys.get(n) == c, targets.get((n, c)), db.times.get(n) == c) for n, d in db.tables.items() for i, (c, kind) in enumerate(d.dtypes)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, is_key boolean, target string, is_time boolean")


def describe(tables: dict[str, DataFrame], foreign_keys: list[ForeignKey] = ()) -> DataFrame:
    """(table, column, type, target) of a set of tables, in order."""
    spark = next(iter(tables.values())).sparkSession
    targets = {(k.table, k.column): k.target for k in foreign_keys}
    rows = [(n, i, c, t, targets.get((n, c))) for n, d in tables.items() for i, (c, t) in enumerate(d.dtypes)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, target string")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for n, d in tables.items():
        row = d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def synthetic_shop(
    spark: SparkSession, users: int = 400, items: int = 120, per_user: int = 12, span: float = 1000.0, seed_at: float = 0.7, horizon: float = 0.3, seed: int = 42
) -> tuple[RelationalDB, DataFrame]:
    """Users, items and transactions with churn and ltv labels, made on the executors from hashed draws.

    A user's activity is skewed (the square of a draw); transactions up to the seed time are rows, later
    ones only make the labels. Labels carry the user's row.
    """
    u = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    at, end = span * seed_at, span * (seed_at + horizon)
    k = lambda name: F.lit(name)
    i = F.col("_row")
    person = spark.range(users).withColumnRenamed("id", "_row").select(
        "_row", (18 + 52 * u(k("age"), i)).cast("float").alias("age"), F.floor(6 * u(k("country"), i)).alias("country"), (u(k("signup"), i) * at * 0.5).alias("_time"), F.pow(u(k("activity"), i), 2.0).alias("_a")
    )
    thing = spark.range(items).withColumnRenamed("id", "_row").select("_row", (5 + 495 * u(k("price"), i)).cast("float").alias("price"), F.floor(8 * u(k("category"), i)).alias("category"), F.lit(0.0).alias("_time"))
    n = F.ceil(3 * per_user * F.col("_a") / math.sqrt(seed_at + horizon)).cast("int")
    buys = person.select(F.col("_row").alias("user_id"), "_time", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("j"))
    j = [F.col("user_id"), F.col("j")]
    buys = buys.select("user_id", F.floor(items * u(k("item"), *j)).alias("item_id"), (F.col("_time") + (F.lit(end) - F.col("_time")) * u(k("when"), *j)).alias("_time"), (0.5 + u(k("factor"), *j)).alias("f"), "j")
    buys = buys.join(thing.select(F.col("_row").alias("item_id"), "price"), "item_id").withColumn("amount", (F.col("price") * F.col("f")).cast("float"))
    future = buys.where(F.col("_time") > at).groupBy("user_id").agg(F.sum("amount").alias("ltv"))
    labels = person.select("_row").join(future.withColumnRenamed("user_id", "_row"), "_row", "left").select("_row", F.coalesce(F.col("ltv").cast("float"), F.lit(0.0).cast("float")).alias("ltv"), F.when(F.col("ltv").isNull(), 1.0).otherwise(0.0).cast("float").alias("churn"))
    past = row_index(buys.where(F.col("_time") <= at).select("user_id", "item_id", "amount", "_time", "j"), ["_time", "user_id", "j"]).drop("j")
    tables = {"users": person.drop("_a"), "items": thing, "transactions": past}
    keys = [ForeignKey("transactions", "user_id", "users"), ForeignKey("transactions", "item_id", "items")]
    return RelationalDB("shop", tables, keys, dict.fromkeys(tables, "_row"), dict.fromkeys(tables, "_time")), labels


def save_database(db: RelationalDB, folder: str, **metadata: str) -> None:
    """tables/ in Parquet, schema.json with keys, foreign keys and event times, and metadata.json."""
    spark = next(iter(db.tables.values())).sparkSession
    save_parquet(db.tables, f"{folder}/tables", "overwrite")
    keys = [[k.table, k.column, k.target] for k in db.foreign_keys]
    write_text(spark, f"{folder}/schema.json", json.dumps({"name": db.name, "tables": list(db.tables), "keys": db.keys, "times": db.times, "foreign_keys": keys}, indent=2))
    write_text(spark, f"{folder}/metadata.json", json.dumps(metadata, indent=2))


def load_database(spark: SparkSession, folder: str) -> tuple[RelationalDB, dict]:
    """The database that save_database wrote, checked, and its metadata."""
    d = json.loads(_text(spark, f"{folder}/schema.json"))
    db = RelationalDB(d["name"], load_parquet(spark, f"{folder}/tables", d["tables"]), [ForeignKey(*k) for k in d["foreign_keys"]], d["keys"], d["times"])
    db.check()
    return db, json.loads(_text(spark, f"{folder}/metadata.json"))


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame], **parameters) -> DataFrame:
    """A query over {tables} in braces with :parameters, which are bound and never pasted into the text."""
    return spark.sql(query, args=parameters, **tables)


def load_embeddings(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Vectors of a node type from emb_<kind>.parquet, as arrays of doubles; raises without a column ``embedding``."""
    df = spark.read.parquet(f"{folder}/emb_{kind}.parquet")
    if "embedding" not in df.columns:
        raise ValueError(f"emb_{kind}.parquet has no column embedding")
    return df.withColumn("embedding", F.col("embedding").cast("array<double>"))
