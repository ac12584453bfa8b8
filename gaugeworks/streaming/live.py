"""Streams of results and log entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet events as a stream; event times without a zone are taken in the session's."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes of each action in a window of event time; later entries than the watermark do not count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Editing sessions of each user."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def latest(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last entry of each key, as a stream in update mode: the state is one row for each key."""
    fields = F.struct(*[c for c in events.columns if c not in key])
    return events.groupBy(*key).agg(F.max_by(fields, order).alias("last")).select(*key, "last.*")


def upserts_into(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch's last entries as one folder; the same batch again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
