"""Well timelines: calendar days, stages, lists and hour shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_days(facts: DataFrame) -> DataFrame:
    """Hours per well and day, negatives clipped, with each kind's share of the day."""

    def clipped(c):
        return F.sum(F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))

    days = facts.groupBy("wellbore", "report_date").agg(
        clipped("p_h").alias("p"), clipped("sc_h").alias("sc"), clipped("npt_h").alias("npt")
    )
    total = F.col("p") + F.col("sc") + F.col("npt")
    share = {k: F.when(total == 0, F.lit(0.0)).otherwise(F.col(k) / total) for k in ("p", "sc", "npt")}
    return days.select("*", *[c.alias(f"{k}_share") for k, c in share.items()])


def stage() -> Column:
    """move or drilling for drilling reports whose event says so, else null."""
    event = F.lower("event")
    own = F.col("report_type") == "drilling"
    return F.when(own & event.contains("rig move"), "move").when(own & event.contains("drilling"), "drilling")


def stage_days(records: DataFrame) -> DataFrame:
    days = (
        records.filter("report_type = 'drilling' and report_date <> ''")
        .select("wellbore", "report_date", stage().alias("stage"))
        .distinct()
    )
    return days.groupBy("wellbore").agg(
        F.count_if(F.col("stage") == "move").alias("move_days"),
        F.count_if(F.col("stage") == "drilling").alias("drilling_days"),
    )


def well_list(facts: DataFrame, sort_by: str = "name") -> DataFrame:
    """Wells with day count, first and last date; newest first unless by name."""
    wells = (
        facts.filter("wellbore <> ''")
        .groupBy("wellbore")
        .agg(
            F.countDistinct("report_date").alias("days"),
            F.min("report_date").alias("first_date"),
            F.max("report_date").alias("last_date"),
            F.bool_or(F.greatest(F.lit(0.0), F.coalesce("npt_h", F.lit(0.0))) > 0).alias("has_npt"),
        )
    )
    order = {"first": [F.desc("first_date"), F.col("wellbore")], "last": [F.desc("last_date"), F.col("wellbore")]}
    return wells.orderBy(*order.get(sort_by, [F.col("wellbore")]))


def hour_shares(facts: DataFrame) -> DataFrame:
    """Whole percent of P, SC and NPT hours per well, halves up, 0 without hours."""

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0.0))

    sums = facts.groupBy("wellbore").agg(*[total(f"{k}_h").alias(k) for k in ("p", "sc", "npt", "total")])
    return sums.select(
        "wellbore",
        *[
            F.when(F.col("total") > 0, F.floor(F.col(k) / F.col("total") * 100 + 0.5))
            .otherwise(F.lit(0))
            .alias(f"{k}_share")
            for k in ("p", "sc", "npt")
        ],
    )


def well_search(records: DataFrame, text: str = "", month: str = "", day: str = "") -> DataFrame:
    out = records
    if text:
        out = out.filter(F.lower("wellbore").contains(text.lower()))
    if month:
        out = out.filter(F.col("report_date").startswith(month))
    if day:
        out = out.filter(F.col("report_date") == day)
    return out
