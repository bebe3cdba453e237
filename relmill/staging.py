"""Tables that cut a lineage, in the shared folder that the session names in ``spark.checkpoint.dir``.

Where the session sets none the SQL warehouse folder is used, on one machine (tests, a laptop) or where its path names a
shared store; a cluster whose warehouse is a local folder is refused. So a lost executor costs a re-read, never data.
The tables go when the driver process ends.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_warehouse(path: str, master: str) -> str:
    """The warehouse folder, if all executors can see it: any on one machine, on a cluster one with a scheme but file."""
    local = re.match(r"local(\[.*\])?$", master)
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if not local and (scheme is None or scheme[1].lower() == "file"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; {path} is local to each machine")
    return path


class Scratch:
    def __init__(self, spark: SparkSession, merge: bool = False):
        """With ``merge`` joins with the stored tables are shuffled and sorted. A loop over tables that grow with the input
        needs that: columns of ids take so little room in a file that Spark would send millions of rows by way of the driver,
        in every round."""
        base = spark.conf.get("spark.checkpoint.dir", None) or shared_warehouse(spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
        self.spark, self.merge = spark, merge
        self.root = f"{base.rstrip('/')}/relmill-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        self.stored: list[str] = []
        self.tables: dict[str, str] = {}
        atexit.register(self.drop, self.root)

    def store(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
        out = self.shuffled(self.spark.read.schema(df.schema).parquet(path))
        out.scratch_path = path
        self.stored.append(path)
        return out

    def deal(self, df: DataFrame, name: str, rows: int, key: str) -> DataFrame:
        """``df`` stored in buckets of a key, of about 500,000 of its ``rows`` rows each: joins with it and sums of it by the key
        do not shuffle it. For a table that many passes read."""
        path, n = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}", files_for(rows, 500_000)
        self.tables[path] = f"relmill_{uuid.uuid4().hex}"
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(self.tables[path], format="parquet")
        out = self.shuffled(self.spark.table(self.tables[path]))
        out.scratch_path = path
        self.stored.append(path)
        return out

    def shuffled(self, df: DataFrame) -> DataFrame:
        """``df``, joined like a stored table."""
        return df.hint("merge") if self.merge else df

    def drop_since(self, mark: int, *keep: DataFrame) -> None:
        """Drops the tables stored after the first ``mark`` but those to keep; for work whose result is stored."""
        held = {df.scratch_path for df in keep}
        for path in self.stored[mark:]:
            if path not in held:
                self.drop(path)
        self.stored[mark:] = [p for p in self.stored[mark:] if p in held]

    def drop(self, what) -> None:
        path = what if isinstance(what, str) else getattr(what, "scratch_path", None)
        if path is None:  # not a scratch table
            return
        try:
            for at in [p for p in self.tables if p == path or p.startswith(f"{path}/")]:
                self.spark.sql(f"drop table if exists {self.tables.pop(at)}")
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # noqa: BLE001 - the JVM may have gone before the interpreter's exit hooks run
            pass


def files_for(rows: int, per_file: int = 250_000) -> int:
    """Number of output files for a small intermediate table; grows with the rows."""
    return max(2, -(-rows // per_file))


def spread(df: DataFrame, rows: int, *keys: str, per_part: int = 500_000) -> DataFrame:
    """``df`` dealt by keys over parts of about ``per_part`` of ``rows`` rows, for steps that hold or sort a part: Spark sizes
    parts by their compressed bytes, of which columns of ids take so few that millions of rows would meet in one task."""
    return df.repartition(files_for(rows, per_part), *keys)
