"""Event logs: latest rows, retention, job states and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tourlog.operators import ordering
from tourlog.session import materialise


def latest_per_kind(events: DataFrame, kind: str, order: list[str], n: int) -> DataFrame:
    """Last ``n`` events (at most 100) of each kind, newest first."""
    return ordering.top_rows(events, [kind], [F.desc(c) for c in order], max(1, min(100, n)))


def tail(events: DataFrame, order: list[str], n: int) -> DataFrame:
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def retention(log: DataFrame, time: str, order: str, line: str, now: str, days: int, max_entries: int, max_bytes: int) -> DataFrame:
    """Rows to keep: recent ones, the last ``max_entries`` of them, newest within the byte budget.

    A row larger than the whole budget is passed over; older rows stop at the
    first that no longer fits.  ``order`` is unique.  Rows lie in ranges of
    ``order``; a row's number and running sum are those inside its range plus a
    small table of the ranges before, so no task holds all kept rows.
    """
    stamp = F.try_to_timestamp(time)
    recent = log.filter(stamp >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max(0, days))))
    ranged = recent.withColumn("bytes", F.octet_length(line) + 1).repartitionByRange(F.desc(order))
    # written, as borders of ranges are sampled and must not move between the two readings
    ranges = materialise(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    numbered = _running(ranges, order, F.lit(1), "_no").filter(F.col("_no") <= max_entries)
    sized = numbered.filter(F.col("bytes") <= max_bytes)
    return _running(sized, order, F.col("bytes"), "_sum").filter(F.col("_sum") <= max_bytes).drop("_sum", "_no", "_range")


def _running(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` from the newest row on, over rows in ranges ``_range``."""
    totals = rows.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_range").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(offsets, "_range").withColumn(name, F.sum(value).over(inside) + F.col("_before")).drop("_before")


def retention_report(log: DataFrame, kept: DataFrame) -> DataFrame:
    before = log.agg(F.count(F.lit(1)))
    return kept.agg(F.count(F.lit(1)).alias("after"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select(
        before.scalar().alias("before"), "after", "bytes"
    )


def latest_state(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Newest row per key by a partial aggregate."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return events.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def current_generations(events: DataFrame, key: str, generation: str) -> DataFrame:
    return events.groupBy(key).agg(F.max(generation).alias("current_generation"))


def drop_stale(events: DataFrame, current: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of an older generation of their job are discarded."""
    joined = events.join(current, key, "left")
    fresh = F.col("current_generation").isNull() | (F.col(generation) >= F.col("current_generation"))
    return joined.filter(fresh).drop("current_generation")


def usage_by_day(events: DataFrame, time: str) -> DataFrame:
    """Daily counts and sums per event type, each event id once."""
    once = events.dropDuplicates(["event_id"])
    return once.groupBy(F.window(time, "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")
    ).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")
