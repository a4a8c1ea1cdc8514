"""Operation facts with the current translation and extraction of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import scalars as S


def translation_state(details: Column) -> tuple[Column, Column]:
    """(text, status) of a joined translation row ``t_*``; text only if current."""
    squeezed = [S.squeeze(c) for c in (F.col("t_source_text"), details)]
    same = (F.col("t_source_hash") == S.source_hash(details)) | (
        (F.col("t_source_text") != "") & (squeezed[0] == squeezed[1])
    )
    status = F.upper(F.trim(S.text(F.col("t_status"))))
    usable = same & (status == "COMPLETED") & ~S.blank(F.col("t_text"))
    return (
        F.when(usable, F.trim("t_text")).otherwise(F.lit("")),
        F.when(usable, F.lit("COMPLETED")).otherwise(S.pick(status, F.lit("MISSING"))),
    )


def extraction_state(details: Column, op_type: Column, version: str) -> tuple[Column, Column]:
    """(result, status) of a joined extraction row ``e_*``.

    Only NPT rows need one; a changed source or another rule version makes a
    result stale, though the text of a merely outdated version stays visible.
    """
    absent = F.col("e_source_hash").isNull()
    stale = F.col("e_source_hash") != S.source_hash(S.trimmed(details))
    status = S.pick(F.upper(F.trim(S.text(F.col("e_status")))), F.lit("PENDING"))
    old = (status == "COMPLETED") & F.lit(bool(version)) & (S.text(F.col("e_version")) != version)
    state = (
        F.when(op_type != "NPT", "NOT_REQUIRED")
        .when(absent, "PENDING")
        .when(stale | old, "STALE")
        .otherwise(status)
    )
    shown = F.when((op_type != "NPT") | absent | stale, F.lit("")).otherwise(S.trimmed(F.col("e_result")))
    return shown, state


def fact_operations(
    records: DataFrame, operations: DataFrame, translations: DataFrame, extractions: DataFrame, version: str
) -> DataFrame:
    """The wide operation fact: report, project, row, translation, extraction.

    The two lookups share the key (record_id, row_no), which spreads even one
    huge report over all tasks; the header joins last by record_id.
    """
    t = translations.filter("target_language = 'zh-CN' and field_code = 'operations.operation_details'").select(
        "record_id", F.element_at(F.split("entity_id", ":"), -1).cast("int").alias("row_no"),
        F.col("source_text").alias("t_source_text"), F.col("source_hash").alias("t_source_hash"),
        F.col("translated_text").alias("t_text"), F.col("translation_status").alias("t_status"),
    )
    e = extractions.filter("target_field = 'service_line' and source_section = 'operations'").select(
        "record_id", F.col("source_row_no").alias("row_no"), F.col("source_hash").alias("e_source_hash"),
        F.col("result_text").alias("e_result"), F.col("extraction_status").alias("e_status"),
        F.col("rule_version").alias("e_version"),
    )
    rows = operations.join(t, ["record_id", "row_no"], "left").join(e, ["record_id", "row_no"], "left")
    details = F.col("operation_details")
    text, text_status = translation_state(details)
    line, line_status = extraction_state(details, F.col("eff_type"), version)
    enriched = rows.select(
        "record_id", "row_no", F.col("h").alias("hours"), F.col("eff_type").alias("op_type"), "op_code", "op_sub",
        "reason", S.time_range(F.col("from_time"), F.col("to_time")).alias("time_range"), "operation_details",
        text.alias("translated"), text_status.alias("translation_status"),
        S.pick(line, F.col("service_line")).alias("service_line"), line_status.alias("extraction_status"),
    )
    return enriched.join(
        records.select(
            "record_id", "report_type", "report_date", F.substring("report_date", 1, 7).alias("month"), "wellbore", "rig",
            "project_id", "project_name", "project_contract", "validation_status", "event",
        ),
        "record_id",
    )


def extraction_reference(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Exact current translation of each unit; the first stored row wins."""
    usable = translations.filter(
        (S.normalize_language(F.col("target_language")) == "zh-CN")
        & F.col("translation_status").isin("COMPLETED", "NOT_REQUIRED")
    )
    key = ["entity_id", "field_code", "source_hash"]
    first = usable.groupBy(*key).agg(F.min_by("translated_text", F.struct("created_at", "translated_text")).alias("ref"))
    return units.join(first, key, "left").withColumn("reference", F.trim(F.coalesce("ref", F.lit("")))).drop("ref")
