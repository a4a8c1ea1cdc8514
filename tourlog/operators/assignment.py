"""Which projects a report belongs to: an effective-dated, alias-aware join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S

ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def in_range(value: Column, start: Column, end: Column) -> Column:
    """Lexical date range; an open range accepts any text, even a bad date."""
    open_range = (start == "") & (end == "")
    inside = value.rlike(ISO_DATE) & ((start == "") | (value >= start)) & ((end == "") | (value <= end))
    return open_range | inside


def alias_links(team_names: DataFrame) -> DataFrame:
    """(configured, reported): names that the first team holding the
    configured name also holds.  ``team_names`` has (team_ord, name) rows."""
    names = team_names.select("team_ord", "name").filter(F.col("name") != "").distinct()
    first = names.groupBy(F.col("name").alias("configured")).agg(F.min("team_ord").alias("team_ord"))
    return first.join(names, "team_ord").select("configured", F.col("name").alias("reported"))


def reachable_bindings(bindings: DataFrame, team_names: DataFrame) -> DataFrame:
    """Bindings repeated under every reported rig name they can match."""
    links = alias_links(team_names).filter(F.col("configured") != F.col("reported"))
    other = bindings.join(links, F.col("rig") == F.col("configured")).drop("configured")
    return bindings.withColumn("reported", F.col("rig")).unionByName(other)


def project_windows(bindings: DataFrame, team_names: DataFrame) -> DataFrame:
    """One row per (project, reported rig) with its dated well lists.

    Contract bindings are configuration: a project lists a rig once and a rig
    has a handful of aliases, so the list per row stays short.
    """
    active = bindings.filter(S.pick(F.col("project_status"), F.lit("active")) == "active")
    window = F.struct("rig_start", "rig_end", "wells")
    return (
        reachable_bindings(active, team_names)
        .groupBy("reported", "project_id", "project_contract", "project_title", "project_start", "project_end")
        .agg(F.collect_set(window).alias("windows"))
        .withColumn(
            "project_name", S.pick(F.col("project_title"), F.col("project_contract"), F.col("project_id"))
        )
        .drop("project_title")
    )


def assign_projects(records: DataFrame, windows: DataFrame, how: str = "inner") -> DataFrame:
    """Join reports to every project that claims them, once per project.

    The rig name is the equi key, dates and wells are the residual; the dated
    lists are tested inside the row, so no de-duplication shuffle of the
    reports is needed.  Spark broadcasts the windows when statistics show them
    small and falls back to a shuffle join with skew splitting otherwise.
    """
    date, well = F.trim(F.col("report_date")), F.trim(F.col("wellbore"))
    claimed = F.exists(
        "windows",
        lambda w: in_range(date, w["rig_start"], w["rig_end"])
        & ((F.size(w["wells"]) == 0) | F.array_contains(w["wells"], well)),
    )
    on = (
        (F.col("rig") == F.col("reported"))
        & S.valid_rig(F.col("rig"))
        & in_range(date, F.col("project_start"), F.col("project_end"))
        & claimed
    )
    return records.join(windows, on, how).drop("windows", "reported", "project_start", "project_end")


def with_projects(records: DataFrame, windows: DataFrame, project_mode: bool) -> DataFrame:
    """Left form: reports without a project stay once, marked in project mode."""
    none_id, none_name = (dims.UNASSIGNED_ID, dims.UNASSIGNED_NAME) if project_mode else ("", "")
    return assign_projects(records, windows, "left").select(
        *records.columns,
        F.coalesce("project_id", F.lit(none_id)).alias("project_id"),
        F.coalesce("project_name", F.lit(none_name)).alias("project_name"),
        F.coalesce("project_contract", F.lit("")).alias("project_contract"),
    )


def pending_wells(records: DataFrame, windows: DataFrame) -> DataFrame:
    """(rig, well) pairs of valid reports that no project claims."""
    own = records.filter(
        F.col("report_type").isin("drilling", "completion", "workover")
        & S.valid_rig(F.col("rig"))
        & ~S.blank(F.col("wellbore"))
    )
    loose = assign_projects(own, windows, "left").filter(F.col("project_id").isNull())
    scan = F.struct("report_date", "updated_at", "rk")
    return loose.groupBy("rig", F.trim("wellbore").alias("wellbore")).agg(
        F.max_by("report_type", scan).alias("report_type"), F.max_by("record_id", scan).alias("record_id")
    )
