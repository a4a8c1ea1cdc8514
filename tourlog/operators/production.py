"""Production reports: hours by rig, type and month, coverage, project timelines.

Every report starts from hours summed per record (``hours_by_record``), so the
operation rows cross the network once, pre-aggregated in the map tasks, and all
later grouping works on one row per report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S

ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
# newest report first; ties by last update, then by key
SCAN = ("report_date", "updated_at", "rk")


def hours_of(op_type: str, hours: str = "h", kind: str = "eff_type") -> Column:
    return F.sum(F.when(F.col(kind) == op_type, F.col(hours)).otherwise(0.0))


def hours_by_record(operations: DataFrame) -> DataFrame:
    return operations.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_ops"),
        F.sum("h").alias("total_h"),
        hours_of("P").alias("p_h"),
        hours_of("SC").alias("sc_h"),
        hours_of("NPT").alias("npt_h"),
        F.count_if(F.col("eff_type") == "NPT").alias("n_npt"),
    )


def record_hours(records: DataFrame, hours: DataFrame) -> DataFrame:
    """P, SC and NPT hours of every report, zero where it has no operations."""
    zero = F.lit(0.0)
    return records.join(hours, "record_id", "left").select(
        "record_id",
        F.coalesce("p_h", zero).alias("p_hours"),
        F.coalesce("sc_h", zero).alias("sc_hours"),
        F.coalesce("npt_h", zero).alias("npt_hours"),
    )


def npt_by_rig(facts: DataFrame) -> DataFrame:
    """NPT hours per rig; rigs without NPT show zero, the blank rig only if it has any."""
    return (
        facts.groupBy("rig")
        .agg(F.sum(F.coalesce("npt_h", F.lit(0.0))).alias("hours"), F.sum("n_npt").alias("n"))
        .filter((F.col("rig") != "") | (F.col("n") > 0))
        .select(S.pick(F.col("rig"), F.lit(dims.UNKNOWN_RIG)).alias("label"), "hours")
        .orderBy(F.desc("hours"), "label")
    )


def hours_pivot(facts: DataFrame, key: Column, name: str) -> DataFrame:
    """Hours per key with one column per report type (fixed four, no pivot scan)."""
    return (
        facts.filter("n_ops > 0")
        .groupBy(key.alias(name))
        .agg(
            *[
                F.sum(F.when(F.col("report_type") == t, F.col("total_h")).otherwise(0.0)).alias(t)
                for t in dims.REPORT_TYPES
            ]
        )
    )


def hours_by_type(facts: DataFrame) -> DataFrame:
    """One row per known type, also for types without hours."""
    wide = facts.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("report_type") == t, F.col("total_h"))), F.lit(0.0)).alias(t)
            for t in dims.REPORT_TYPES
        ]
    )
    long = wide.unpivot([], list(dims.REPORT_TYPES), "report_type", "hours")
    return long.withColumn("label", S.labelled(F.col("report_type"), dims.REPORT_TYPE_LABELS))


def completeness_columns() -> list[Column]:
    """Aggregates for coverage of a calendar by report dates.

    The number of calendar gaps is the span minus the distinct valid dates, so
    no calendar has to be generated.
    """
    date = F.nullif(F.col("report_date"), F.lit(""))
    valid = F.when(date.rlike(ISO_DATE), date)
    warn = F.when(F.col("validation_status") == "warning", date)
    return [
        F.countDistinct(date).alias("days"),
        F.countDistinct(warn).alias("warning_days"),
        F.coalesce(
            F.date_diff(F.to_date(F.max(valid)), F.to_date(F.min(valid))) + 1 - F.countDistinct(valid), F.lit(0)
        ).cast("bigint").alias("missing_days"),
    ]


def coverage_percent() -> Column:
    expected = F.col("days") + F.col("missing_days")
    raw = (F.col("days") - F.col("warning_days") * 0.35) / expected * 100
    return F.when(expected == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), raw))


def completeness(records: DataFrame, *keys: str) -> DataFrame:
    """Coverage per key, percent unrounded; dates are made distinct first."""
    days = records.groupBy(*keys, "report_date").agg(F.max("validation_status").alias("validation_status"))
    return days.groupBy(*keys).agg(*completeness_columns()).withColumn("percent", coverage_percent())


def production_kpis(facts: DataFrame) -> DataFrame:
    """Rig, well and day counts with total and NPT hours in one row.

    Reports are first folded to (rig, well, date, status), which is what the
    distinct counts need; only that small table is expanded.
    """
    folded = facts.groupBy("rig", "wellbore", "report_date", "validation_status").agg(
        F.sum("total_h").alias("total_h"), F.sum("npt_h").alias("npt_h")
    )
    row = folded.agg(
        F.countDistinct(F.nullif(F.col("rig"), F.lit(""))).alias("rig_count"),
        F.countDistinct(F.nullif(F.col("wellbore"), F.lit(""))).alias("well_count"),
        F.coalesce(F.sum("total_h"), F.lit(0.0)).alias("total_hours"),
        F.coalesce(F.sum("npt_h"), F.lit(0.0)).alias("npt_hours"),
        *completeness_columns(),
    )
    return row.withColumn("percent", coverage_percent())


def missing_dates(records: DataFrame, *keys: str) -> DataFrame:
    """Calendar days without a report between the first and last of each key.

    Works on distinct dates (bounded by the calendar, not by the reports) and
    expands only the gaps.
    """
    dates = (
        records.filter(F.col("report_date").rlike(ISO_DATE))
        .select(*keys, F.try_to_timestamp("report_date", F.lit("yyyy-MM-dd")).cast("date").alias("d"))
        .filter("d is not null")
        .distinct()
    )
    gaps = dates.withColumn("next", F.lead("d").over(W.partitionBy(*keys).orderBy("d"))).filter(
        F.date_diff("next", "d") > 1
    )
    day = F.explode(F.sequence(F.date_add("d", 1), F.date_sub("next", 1)))
    return gaps.select(*keys, day.alias("day")).select(
        *keys, F.date_format("day", "yyyy-MM-dd").alias("missing_date")
    )


def production_details(facts: DataFrame) -> DataFrame:
    """Hours and dates per (project, rig, well, type).

    The status is that of the last report in scan order, i.e. the oldest; a
    blank rig is shown under a label that matches no report and never warns.
    """
    scan = F.struct(*SCAN)
    key = ["project_id", "rig", "wellbore", "report_type"]
    worked = F.col("n_ops") > 0
    rows = facts.groupBy(*key).agg(
        F.max_by("project_name", F.when(worked, scan)).alias("project_name"),
        F.min(F.when(worked, F.col("report_date"))).alias("start_date"),
        F.max(F.when(worked, F.col("report_date"))).alias("end_date"),
        F.max_by("record_id", F.when(worked, scan)).alias("record_id"),
        F.sum("total_h").alias("hours"),
        F.sum("npt_h").alias("npt_hours"),
        F.min_by("validation_status", scan).alias("oldest_status"),
        F.sum("n_ops").alias("n_ops"),
    )
    warns = (F.col("oldest_status") == "warning") & (F.col("rig") != "")
    return rows.filter("n_ops > 0").select(
        "project_id",
        "project_name",
        S.pick(F.col("rig"), F.lit(dims.UNKNOWN_RIG)).alias("rig"),
        "wellbore",
        "report_type",
        "start_date",
        "end_date",
        *[
            F.when(F.col("report_type") == t, F.col("hours")).otherwise(0.0).alias(f"{t}_hours")
            for t in dims.REPORT_TYPES
        ],
        "npt_hours",
        "record_id",
        F.when(warns, dims.STATUS_WARNING).otherwise(dims.STATUS_NORMAL).alias("status"),
    )


def stage_dates() -> dict[str, Column]:
    """First and last dates of the life of a well, '' where not reached."""
    event, kind = F.lower("event"), F.col("report_type")
    date = F.nullif(F.col("report_date"), F.lit(""))
    moving = (kind == "drilling") & event.contains("rig move")
    drilling = (kind == "drilling") & event.contains("drilling")
    working = (kind == "workover") & event.contains("workover")

    def day(fold, when):
        return F.coalesce(fold(F.when(when, date)), F.lit(""))

    return {
        "move_date": day(F.min, moving),
        "drilling_start_date": day(F.min, drilling),
        "drilling_finish_date": day(F.max, drilling),
        "completion_date": day(F.max, kind == "completion"),
        "workover_date": day(F.min, working),
    }


def project_report(facts: DataFrame, remarks: DataFrame, contractor: str) -> DataFrame:
    """Timeline and hours per (project, rig, well) with saved remarks."""
    scan = F.struct(*SCAN)
    hours = {
        f"{t}_hours": F.coalesce(F.sum(F.when(F.col("report_type") == t, F.col("total_h"))), F.lit(0.0))
        for t in ("move", "drilling", "completion", "workover")
    }
    rows = facts.groupBy(
        "project_id", S.pick(F.col("rig"), F.lit(dims.UNKNOWN_RIG)).alias("rig"), "wellbore"
    ).agg(
        F.max_by("project_name", scan).alias("project_name"),
        F.max_by("project_contract", scan).alias("project_contract"),
        F.max_by("record_id", scan).alias("record_id"),
        F.max_by("report_type", scan).alias("report_type"),
        *[c.alias(n) for n, c in stage_dates().items()],
        *[c.alias(n) for n, c in hours.items()],
        F.coalesce(F.sum("npt_h"), F.lit(0.0)).alias("npt_hours"),
        F.when(F.bool_or(F.col("validation_status") == "warning"), dims.STATUS_WARNING)
        .otherwise(dims.STATUS_NORMAL)
        .alias("status"),
    )
    key = F.concat_ws(
        "|", F.trim("project_id"), S.canonical_rig(F.col("rig"), contractor), F.trim("wellbore")
    )
    return (
        rows.withColumn("remark_key", key)
        .join(remarks, "remark_key", "left")
        .withColumn("remarks", F.coalesce("remarks", F.lit("")))
        .withColumn("contract_project", S.contract_label(F.col("project_contract"), F.col("project_name")))
    )


def well_stats(facts: DataFrame, *keys: str) -> DataFrame:
    """Per well (or any key): distinct days, hours, first rig and AFE, stage dates."""
    scan = F.struct(*SCAN)

    def newest(c):
        return F.coalesce(F.max_by(c, F.when(F.col(c) != "", scan)), F.lit(""))

    return facts.groupBy(*keys).agg(
        F.countDistinct(F.nullif(F.col("report_date"), F.lit(""))).alias("days"),
        *[F.coalesce(F.sum(f"{k}_h"), F.lit(0.0)).alias(f"{k}_hours") for k in ("total", "npt", "p", "sc")],
        newest("rig").alias("rig"),
        newest("afe_number").alias("afe_number"),
        *[c.alias(n) for n, c in stage_dates().items() if n != "drilling_finish_date"],
    )


def sort_export(rows: DataFrame, field: str, direction: str, numeric: tuple[str, ...]) -> DataFrame:
    """Export order: empties last when ascending and first when descending.

    The whole table is range-partitioned by the sort key; no single task sorts it.
    """
    if not field:
        return rows
    empty = F.coalesce(F.col(field).cast("string"), F.lit("")) == ""
    value = S.safe_float(F.col(field)) if field in numeric else F.col(field).cast("string")
    keys = [empty, F.when(~empty, value)]
    return rows.orderBy(*[k.asc() if direction == "asc" else k.desc() for k in keys])


def filter_options(records: DataFrame, bindings: DataFrame, contractor: str) -> DataFrame:
    """Distinct (kind, value) pairs that the report filters offer."""
    active = bindings.filter(S.pick(F.col("project_status"), F.lit("active")) == "active")
    planned = active.select(S.canonical_rig(F.col("rig"), contractor).alias("value"))
    rigs = records.select(F.col("rig").alias("value")).distinct().unionByName(planned)
    wells = records.select(F.col("wellbore").alias("value")).filter("value <> ''")
    projects = active.select(F.col("project_id").alias("value")).filter("trim(value) <> ''")
    return (
        rigs.filter(S.valid_rig(F.col("value")))
        .withColumn("kind", F.lit("rig"))
        .unionByName(wells.withColumn("kind", F.lit("well")))
        .unionByName(projects.withColumn("kind", F.lit("project")))
        .select("kind", "value")
        .distinct()
    )


def records_by_type(records: DataFrame) -> DataFrame:
    """Counts per type and a total row, in one rollup pass."""
    kind = S.pick(F.col("report_type"), F.lit("unknown"))
    return (
        records.withColumn("kind", kind)
        .rollup("kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce("kind", F.lit("total")).alias("report_type"), "n")
    )


def filter_facts(
    records: DataFrame,
    date_from: str = "",
    date_to: str = "",
    rigs: tuple[str, ...] = (),
    report_type: str = "",
    wellbore: str = "",
    contractor: str = "",
) -> DataFrame:
    """Header predicates of a report request, pushed below every join.

    Multi-valued parameters may hold comma-separated lists.
    """
    out = records
    if date_from:
        out = out.filter(F.col("report_date") >= date_from)
    if date_to:
        out = out.filter(F.col("report_date") <= date_to)
    names = [part.strip() for value in rigs for part in value.split(",") if part.strip()]
    if names:
        wanted = [S.canonical_rig(F.lit(n), contractor) for n in names]
        out = out.filter(F.col("rig").isin(*wanted))
    if report_type:
        out = out.filter(F.col("report_type") == report_type)
    if wellbore:
        out = out.filter(F.lower("wellbore").contains(wellbore.lower()))
    return out
