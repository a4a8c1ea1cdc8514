"""Export shapes and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import scalars as S


def dashed(c: Column) -> Column:
    return S.pick(c, F.lit("-"))


def production_export(rows: DataFrame, show_rig: bool = False) -> DataFrame:
    """Fixed column order of the production report; empty cells become '-'."""
    hours = ["move_hours", "drilling_hours", "completion_hours", "workover_hours", "npt_hours"]
    dates = ["move_date", "drilling_start_date", "drilling_finish_date", "completion_date", "workover_date"]
    label = S.pick(F.col("contract_project"), F.col("project_name"), F.lit("-"))
    return rows.select(
        dashed(F.col("wellbore")).alias("wellbore"),
        *([dashed(F.col("rig")).alias("rig")] if show_rig else []),
        label.alias("contract_project"),
        *[dashed(F.col(c)).alias(c) for c in dates],
        *[F.col(c).cast("double").alias(c) for c in hours],
        dashed(F.col("remarks")).alias("remarks"),
    )


def npt_export(rows: DataFrame, show_rig: bool = False) -> DataFrame:
    """Fixed column order of the NPT report; the keyword is the finest code given."""
    return rows.select(
        dashed(F.col("wellbore")).alias("wellbore"),
        *([dashed(F.col("rig")).alias("rig")] if show_rig else []),
        S.pick(F.col("project_name"), F.col("contract_project"), F.lit("-")).alias("project_name"),
        dashed(F.col("report_date")).alias("report_date"),
        dashed(F.col("time_range")).alias("time_range"),
        F.col("hours").cast("double").alias("hours"),
        dashed(F.col("service_line")).alias("service_line"),
        dashed(F.col("extraction_status")).alias("extraction_status"),
        S.pick(F.col("op_sub"), F.col("op_code"), F.col("reason"), F.lit("-")).alias("npt_keyword"),
        dashed(F.col("operation_details")).alias("operation_details"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Partitioned CSV with one header per file; hours are rounded here only."""
    numeric = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "double"}
    rounded = rows.select(*[F.round(c, 2).alias(c) if c in numeric else F.col(c) for c in rows.columns])
    rounded.write.mode("errorifexists").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per parsed table of a document set."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")
