"""Job events over many triggers in any order: what is in time is counted, what is late is kept aside.

The watermark of a batch is the newest event time of the batches before it less
the allowed delay, noted with each batch, so a replay judges alike.  Rows older
than the watermark go to a side table; all others change the result.  Results
plus the side table hold every event once, whatever the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tourlog.streaming.changelog import ChangeLog


class TimedRun:
    """Numbered batches below ``root`` with their watermarks and late rows."""

    def __init__(self, spark: SparkSession, root: str, delay: timedelta):
        self.spark, self.root, self.delay = spark, root.rstrip("/"), delay

    def read(self, name: str, schema: str) -> DataFrame | None:
        """All rows of a table with the number ``b`` of their batch, whole batches only."""
        done = self._read("times", "newest timestamp, b bigint")
        rows = None if done is None else self._read(name, f"{schema}, b bigint")
        return None if rows is None else rows.join(done.select("b"), "b", "left_semi")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def last_batch(self) -> int:
        done = self._read("times", "newest timestamp, b bigint")
        newest = None if done is None else done.agg(F.max("b")).first()[0]
        return -1 if newest is None else newest

    def watermark(self, batch: int):
        """Time before which rows of a batch are late; None before the first one."""
        done = self._read("times", "newest timestamp, b bigint")
        newest = None if done is None else done.filter(F.col("b") < batch).agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.delay

    def put(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.root}/{name}/b={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def split(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows that are in time; the others go to the side table.  Rows without time are late."""
        mark = self.watermark(batch)
        late = F.col("time").isNull() if mark is None else F.col("time").isNull() | (F.col("time") < F.lit(mark))
        self.put(rows.filter(late), "late", batch)
        return rows.filter(~late)

    def run(self, stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
        """Call ``each`` with the staged rows of every new batch, then note its newest time."""

        def take(batch: DataFrame, number: int) -> None:
            if number > self.last_batch():
                staged = self.put(batch, "stage", number)
                each(staged, number)
                self.put(staged.agg(F.max("time").alias("newest")), "times", number)

        query = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(take).start()
        query.awaitTermination()


# --- usage per day -----------------------------------------------------------------------------

_SUMS = "day string, event_type string, n bigint, cents bigint"


def count_usage(events: DataFrame, run: TimedRun, compact_after: int = 64) -> None:
    """Daily usage of (event_id, time, event_type, cents); an event id counts once.

    Ids are remembered, in folders by day, as long as a second copy could be in
    time.  Sums of batches are only added when they are read; every
    ``compact_after`` batches the sums so far become one table.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = run.split(batch, number)
        columns = [c for c in fresh.columns if c != "event_id"]
        once = fresh.groupBy("event_id").agg(F.min(F.struct("time", *[c for c in columns if c != "time"])).alias("r")).select("event_id", "r.*")
        mark, before = run.watermark(number), run.read("ids", "event_id bigint, day string")
        if before is not None:
            if mark is not None:
                before = before.filter(F.col("day") >= mark.strftime("%Y-%m-%d"))
            once = once.join(before.filter(F.col("b") < number).select("event_id"), "event_id", "left_anti")
        dated = run.put(once.withColumn("day", F.date_format("time", "yyyy-MM-dd")), "fresh", number)
        dated.select("event_id", "day").write.mode("overwrite").partitionBy("day").parquet(f"{run.root}/ids/b={number}")
        run.put(dated.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")), "sums", number)
        if (number + 1) % compact_after == 0 and number:
            run.put(usage(run, number), "totals", number)

    run.run(events, each)


def usage(run: TimedRun, before: int | None = None) -> DataFrame:
    """Sums of the events that were in time, of batches up to ``before``."""
    sums, totals = run.read("sums", _SUMS), run.read("totals", _SUMS)
    if sums is None:
        return run.spark.createDataFrame([], _SUMS)
    if before is not None:
        sums = sums.filter(F.col("b") < before)
        totals = None if totals is None else totals.filter(F.col("b") < before)
    upto = None if totals is None else totals.agg(F.max("b")).first()[0]
    if upto is not None:
        # a table of totals stands for all batches before its own
        sums = sums.filter(F.col("b") >= upto).unionByName(totals.filter(F.col("b") == upto))
    return sums.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))


# --- latest state per job --------------------------------------------------------------------------


def state_log(spark: SparkSession, root: str, columns: str, buckets: int = 64) -> ChangeLog:
    """A change log of one row per job: record_id, time, then ``columns``; all of them are compared in this order."""
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType()}
    own = [T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(","))]
    head = [T.StructField("record_id", T.StringType()), T.StructField("time", T.TimestampType())]
    return ChangeLog(spark, f"{root.rstrip('/')}/states", {"states": T.StructType([*head, *own])}, buckets)


def newest_states(rows: DataFrame, log: ChangeLog) -> DataFrame:
    columns = [c for c in log.tables["states"].names if c != "record_id"]
    return rows.groupBy("record_id").agg(F.max(F.struct(*columns)).alias("r")).select("record_id", "r.*")


def keep_states(events: DataFrame, run: TimedRun, log: ChangeLog, ttl: timedelta, compact_after: int = 16) -> None:
    """Latest state per job of (record_id, time, ...); jobs silent for ``ttl`` move to the archive.

    A batch reads the buckets of its jobs and writes their rows.  The archive
    keeps the last state of a job that left; it may come back with a new one.
    """
    if not log.has_base():
        log.load({"states": run.spark.createDataFrame([], log.tables["states"])})

    def each(batch: DataFrame, number: int) -> None:
        fresh = run.split(batch, number).select(*log.tables["states"].names)
        old = log.of("states", fresh)
        new = log.put(number, "states", newest_states(old.unionByName(fresh), log))
        log.touch(number, new)
        log.note(number)
        mark = run.watermark(number)
        if (number + 1) % compact_after == 0 and mark is not None:
            log.compact(F.col("time") < F.lit(mark - ttl))

    run.run(events, each)


def all_states(log: ChangeLog) -> DataFrame:
    """Latest state of every job, those of the archive included."""
    return newest_states(log.state("states").unionByName(log.archive("states")), log)
