"""Structured Streaming over an event log: windows, sessions and a growing edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, name: str, per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet file or folder ``name``, with ts as an event time."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    is_folder = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    raw = reader.parquet(f"{folder}/{name}") if is_folder else reader.option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def edge_stream(events: DataFrame) -> DataFrame:
    """Events as edges from a user to an event type, timed in seconds, to be appended to an edge table."""
    return events.select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), F.unix_timestamp("ts").cast("double").alias("etime"))


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", each=None) -> None:
    """Runs a stream over all that is there, exactly once, into Parquet; ``each`` maps every batch first. In
    complete mode a batch replaces the table."""
    if mode == "append" and each is None:
        q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:

        def sink(batch: DataFrame, number: int) -> None:
            out = each(batch) if each else batch
            out.write.mode("overwrite" if mode == "complete" else "append").parquet(target)

        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
