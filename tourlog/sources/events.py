"""Append-only JSON event logs as a source and a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "time string, kind string, event string, record_id string, generation int, value double"


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Event rows of JSON lines; lines that are not JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stream_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append event rows; a folder per day takes the place of file rotation."""
    events.withColumn("day", F.substring("time", 1, 10)).write.mode("append").partitionBy("day").json(path)
