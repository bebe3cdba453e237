"""Named datasets: what they are, whether they are on disk, making and removing them, loading them with their keys.

A dataset in a folder is a database that ``save_database`` wrote (tables/, schema.json, metadata.json), or a folder of Parquet
files; keys, relations and times of the latter are found from its values (``operators/discovery.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from relmill.functions.scalars import seconds
from relmill.operators.discovery import discover
from relmill.schema import RelationalDB, TaskType
from relmill.sources.tables import load_database, load_parquet, save_database, synthetic_shop


@dataclass(frozen=True)
class Task:
    name: str
    kind: TaskType


@dataclass(frozen=True)
class Dataset:
    """tables are those that a folder must have, ``shop`` the options of a made one, ``valid`` and ``test`` split times."""

    name: str
    domain: str
    tasks: tuple[Task, ...]
    tables: tuple[str, ...] = ()
    shop: tuple[tuple[str, int], ...] = ()
    valid: str | None = None
    test: str | None = None


def _tasks(binary: str = "", regression: str = "") -> tuple[Task, ...]:
    return (*(Task(n, TaskType.BINARY) for n in binary.split()), *(Task(n, TaskType.REGRESSION) for n in regression.split()))


# The names, domains, tasks, tables and split times of the public datasets, and the sizes of the made ones.
DATASETS = {
    d.name: d
    for d in (
        Dataset("shop-small", "e-commerce", _tasks("user-churn", "user-ltv"), ("users", "items", "transactions"), (("users", 400), ("items", 120), ("per_user", 12))),
        Dataset("shop-medium", "e-commerce", _tasks("user-churn", "user-ltv"), ("users", "items", "transactions"), (("users", 2000), ("items", 500), ("per_user", 16))),
        Dataset("rel-f1", "sports", _tasks("driver-dnf driver-top3", "driver-position"), ("drivers", "constructors", "races", "results"), valid="2023-01-01", test="2023-02-01"),
        Dataset("rel-amazon", "e-commerce", _tasks("user-churn item-churn", "user-ltv item-ltv"), ("users", "items", "interactions"), valid="2023-01-01", test="2023-02-01"),
        Dataset("rel-hm", "fashion", _tasks("user-churn", "item-sales"), ("items", "stores", "sales"), valid="2023-01-01", test="2023-02-01"),
        Dataset("rel-stack", "questions and answers", _tasks("user-engagement user-badge", "post-votes")),
        Dataset("rel-trial", "clinical", _tasks("study-outcome", "study-adverse")),
        Dataset("rel-avito", "classifieds", _tasks("user-clicks", "ad-ctr")),
        Dataset("rel-event", "events", _tasks("user-repeat user-ignore")),
    )
}


def find(name: str) -> Dataset:
    if name not in DATASETS:
        raise KeyError(f"unknown dataset: {name}; known are {', '.join(DATASETS)}")
    return DATASETS[name]


def catalogue(spark: SparkSession) -> DataFrame:
    """(dataset, domain, made, task, kind), a row per task."""
    rows = [(d.name, d.domain, bool(d.shop), t.name, t.kind.value) for d in DATASETS.values() for t in d.tasks]
    return spark.createDataFrame(rows, "dataset string, domain string, made boolean, task string, kind string")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def status(spark: SparkSession, name: str, folder: str) -> str:
    """``ready``, ``partial`` (a table that it must have is missing, or the schema beside tables/) or ``absent``."""
    d = find(name)
    saved = _exists(spark, f"{folder}/tables")
    there = [_exists(spark, f"{folder}/{'tables/' if saved else ''}{t}.parquet") for t in d.tables]
    if not _exists(spark, folder):
        return "absent"
    whole = all(there) and (not saved or _exists(spark, f"{folder}/schema.json"))
    return "ready" if whole and (there or saved) else "partial" if any(there) or saved else "absent"


def ensure(spark: SparkSession, name: str, folder: str, seed: int = 42) -> str:
    """Makes a dataset that can be made where it is not ready; others must be put there. Returns ``made`` or ``ready``."""
    d = find(name)
    if status(spark, name, folder) == "ready":
        return "ready"
    if not d.shop:
        raise FileNotFoundError(f"{name}: no tables {list(d.tables)} in {folder}")
    db, labels = synthetic_shop(spark, **dict(d.shop), seed=seed)
    save_database(db, folder, version="1", seed=str(seed))
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return "made"


def delete(spark: SparkSession, name: str, folder: str) -> bool:
    """Removes a dataset's folder; False if there is none. A folder that does not hold the dataset is left alone."""
    if status(spark, name, folder) == "absent":
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def require(db: RelationalDB, tables: tuple[str, ...]) -> None:
    """Raises where a table is missing or the database has none."""
    missing = [t for t in tables if t not in db.tables]
    if missing or not db.tables:
        raise ValueError(f"{db.name}: missing tables {missing or 'of any name'}")


def with_times(db: RelationalDB) -> RelationalDB:
    """The event time of every table that has a date or time column: the first of them, in seconds, as ``_time``."""
    tables, times = {}, dict(db.times)
    for name, df in db.tables.items():
        column = next((f.name for f in df.schema.fields if isinstance(f.dataType, DateType | TimestampType | TimestampNTZType)), None)
        if name not in times and column is not None:
            df, times[name] = df.withColumn("_time", seconds(F.col(column))), "_time"
        tables[name] = df
    return RelationalDB(db.name, tables, db.foreign_keys, db.keys, times)


def load(spark: SparkSession, name: str, folder: str) -> RelationalDB:
    """The dataset in a folder as a checked database with keys, foreign keys and times."""
    d = find(name)
    if _exists(spark, f"{folder}/schema.json"):
        db = load_database(spark, folder)[0]
    else:
        missing = [t for t in d.tables if not _exists(spark, f"{folder}/{t}.parquet")]
        if missing or not d.tables:
            raise ValueError(f"{name}: missing tables {missing or 'of any name'}")
        db = with_times(discover(name, load_parquet(spark, folder, list(d.tables))))
    require(db, d.tables)
    db.check()
    return db
