"""Structured Streaming over events: counts, last states, throttling and session windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curato.operators.graph import shared_dir


def read_events(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """Events as a stream, with a time that watermarks accept; a topic of ``*`` or none takes all."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    rows = source.parquet(path) if not path.endswith(".parquet") else source.option("pathGlobFilter", path.rsplit("/", 1)[-1]).parquet(path.rsplit("/", 1)[0])
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows if topic in (None, "*") else rows.where(F.col("event_type") == topic)


def counts(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, event_type, n, value) by tumbling window; rows later than the delay may be left out."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def last_state(events: DataFrame) -> DataFrame:
    """(user_id, event_type, event_id, value): the last event of each user and type so far."""
    return events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


def first_of_interval(events: DataFrame, interval: str, delay: str = "1 day") -> DataFrame:
    """(start, user_id, event_id): the first event of a user in each interval."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", interval), "user_id")
    return grouped.agg(F.min("event_id").alias("event_id")).select(F.col("window.start").alias("start"), "user_id", "event_id")


def sessions(events: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no longer gap between."""
    grouped = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every event to a table, once: the checkpoint remembers what has been written."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result as a table.

    Each batch of results is written to the shared folder; in complete mode the last one stands for all.
    """
    spark = result.sparkSession
    base = f"{shared_dir(spark)}/curato/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")
