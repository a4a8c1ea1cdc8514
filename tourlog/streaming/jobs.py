"""Structured Streaming forms of the report intake and of the job-event questions.

Every query runs with ``availableNow`` and a checkpoint in the shared folder.
Sinks write one folder per micro-batch and overwrite it on replay, so a batch
that is repeated after the loss of an executor or of the driver leaves no
second copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tourlog.operators import merge, quality
from tourlog.session import shared_dir


def parquet_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream over the Parquet table ``name`` of a folder, one file or a folder of part files."""
    # as a pattern (of the one name) the path may be a file as well as a folder
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name[:-1]}[{name[-1]}]")


def run_to_table(stream: DataFrame, mode: str, purpose: str) -> DataFrame:
    """Run a stream over all available input; rows carry the number of their batch."""
    spark = stream.sparkSession
    root = shared_dir(spark, purpose)
    schema = stream.schema.add("batch_id", "long")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{root}/out/b={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out/*")


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Final row per key of an update-mode result."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id", "b")]
    best = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def usage_windows(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily usage per event type; an event id counts once within the watermark."""
    stamped = events.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", delay)
    once = stamped.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("time", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def job_states(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Latest state per job, kept as streaming state of one row per key."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return events.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def fresh_results(events: DataFrame, current: DataFrame, key: str, generation: str) -> DataFrame:
    """Stream-static join that drops results of an older generation."""
    joined = events.join(current, key, "left")
    fresh = F.col("current_generation").isNull() | (F.col(generation) >= F.col("current_generation"))
    return joined.filter(fresh).drop("current_generation")


def intake(
    arrivals: DataFrame, stored: DataFrame, root: str, order: list[str], after: Callable[[DataFrame, int], None] | None = None
) -> str:
    """Validate and merge arriving reports batch by batch; returns the snapshot folder.

    Batch n reads snapshot n - 1 and writes snapshot n, so a replay starts from
    the same state.  The number of a batch is noted once its snapshot is whole,
    so a later run on the same root goes on from there.  A row that lacks its
    identity is refused for itself; other rows of its report are taken.
    Rejected reports go to a side table with their reason.
    """
    spark = arrivals.sparkSession

    def last_snapshot() -> int | None:
        try:
            return spark.read.schema("batch_id long").parquet(f"{root}/done").agg(F.max("batch_id")).first()[0]
        except AnalysisException as none_yet:
            if "PATH_NOT_FOUND" not in str(none_yet):
                raise
            return None

    def note(batch_id: int) -> None:
        spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("append").parquet(f"{root}/done")

    if last_snapshot() is None:
        stored.write.mode("overwrite").parquet(f"{root}/records/v=-1")
        note(-1)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        old = spark.read.schema(stored.schema).parquet(f"{root}/records/v={batch_id - 1}")
        named = quality.missing_identity(batch).select("record_id", "missing")
        whole = quality.with_identity(batch)
        latest = merge.last_per_key(whole, ["record_id"], order)
        good, bad = merge.split_batch(old, latest)
        merge.upsert_records(old, good.drop(*order)).write.mode("overwrite").parquet(f"{root}/records/v={batch_id}")
        refused = bad.select("record_id", "reason").unionByName(
            named.select("record_id", F.concat(F.lit("missing "), "missing").alias("reason"))
        )
        refused.write.mode("overwrite").parquet(f"{root}/rejected/b={batch_id}")
        if after:
            after(good, batch_id)
        note(batch_id)

    query = (
        arrivals.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        .foreachBatch(merge_batch).start()
    )
    query.awaitTermination()
    return f"{root}/records/v={last_snapshot()}"


def event_sink(events: DataFrame, root: str) -> str:
    """Append a stream of events to a JSON log, one folder per day."""
    query = (
        events.withColumn("day", F.substring("time", 1, 10)).writeStream.format("json").partitionBy("day")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/log")
    )
    query.awaitTermination()
    return f"{root}/log"
