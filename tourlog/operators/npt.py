"""Non-productive time: sums, the confirmation list and the confirmation merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S


def npt_by_reason_per_record(operations: DataFrame) -> DataFrame:
    """NPT hours and events per (record, reason), summed in the map tasks first."""
    return (
        operations.filter("eff_type = 'NPT'")
        .groupBy("record_id", "reason")
        .agg(F.sum("h").alias("hours"), F.count(F.lit(1)).alias("events"))
    )


def sum_hours(rows: DataFrame, key: Column) -> DataFrame:
    """Hours per label, largest first (months as well: the order is by hours)."""
    label = S.pick(key, F.lit(dims.UNKNOWN_LABEL)).alias("label")
    return rows.groupBy(label).agg(F.sum("hours").alias("hours")).orderBy(F.desc("hours"), "label")


def with_share(sums: DataFrame, total: DataFrame) -> DataFrame:
    """Percent of the grand total, unrounded; the total is a scalar subquery."""
    whole = F.coalesce(total.scalar(), F.lit(0.0))
    return sums.withColumn("share", F.when(whole == 0, F.lit(0.0)).otherwise(F.col("hours") / whole * 100))


def system_hours(operations: DataFrame) -> DataFrame:
    """Per record: rows, SC and NPT hours by system type, and whether any is not P."""
    kind = F.col("sys_type")
    return operations.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.when(kind == "SC", F.col("h")).otherwise(0.0)).alias("sc_hours"),
        F.sum(F.when(kind == "NPT", F.col("h")).otherwise(0.0)).alias("npt_hours"),
        F.bool_or(kind.isin("SC", "NPT")).alias("has_non_p"),
    )


def group_status() -> Column:
    """confirmed when all reports are locked, draft when any was touched."""
    state = F.lower(F.trim(S.pick(F.col("confirmation_status"), F.lit("pending"))))
    return (
        F.when(F.count_if(S.truthy(F.col("locked"))) >= F.count(F.lit(1)), "confirmed")
        .when(F.bool_or(state.isin("draft", "confirmed")), "draft")
        .otherwise("pending")
    )


def confirmation_wells(records: DataFrame, hours: DataFrame, status: str = "") -> DataFrame:
    """(rig, well) groups with any non-P system type, pending ones first."""
    date = F.nullif(F.col("report_date"), F.lit(""))
    rows = (
        records.filter("wellbore <> ''")
        .join(hours.filter("has_non_p"), "record_id")
        .groupBy("rig", "wellbore")
        .agg(
            F.coalesce(F.min(date), F.lit("")).alias("start_date"),
            F.coalesce(F.max(date), F.lit("")).alias("end_date"),
            group_status().alias("status"),
            F.count(F.lit(1)).alias("record_count"),
            F.sum("row_count").alias("row_count"),
            F.sum("sc_hours").alias("sc_hours"),
            F.sum("npt_hours").alias("npt_hours"),
        )
    )
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.col("status") != "pending", "end_date", "rig", "wellbore")


def confirmation_meta(records: DataFrame, hours: DataFrame) -> DataFrame:
    """One line per well: dates, status, lock and the first note by date."""
    date = F.nullif(F.col("report_date"), F.lit(""))
    noted = F.when(F.col("confirmation_note") != "", F.struct("report_date", "updated_at", "rk"))
    return (
        records.join(hours.filter("has_non_p"), "record_id")
        .groupBy("wellbore")
        .agg(
            F.coalesce(F.min(date), F.lit("")).alias("start_date"),
            F.coalesce(F.max(date), F.lit("")).alias("end_date"),
            group_status().alias("status"),
            F.count(F.lit(1)).alias("record_count"),
            F.bool_and(S.truthy(F.col("locked"))).alias("locked"),
            F.coalesce(F.max_by("confirmation_note", noted), F.lit("")).alias("confirmation_note"),
        )
    )


def candidates(
    records: DataFrame, operations: DataFrame, rig: str = "", wellbore: str = "", exact: bool = False, scope_rig: str = ""
) -> DataFrame:
    """Reports left-joined to their operations, filtered on the header side first."""
    out = records
    for name in (scope_rig, rig):
        if name:
            out = out.filter(F.col("rig") == name)
    if wellbore:
        match = F.col("wellbore") == wellbore if exact else F.lower("wellbore").contains(wellbore.lower())
        out = out.filter(match)
    return out.join(operations, "record_id", "left")


def default_order(rows: DataFrame) -> DataFrame:
    project = S.pick(F.col("project_name"), F.col("contract_project"))
    return rows.orderBy("wellbore", "report_date", project, "rig")


ROW_FIELDS = (
    "hours", "op_code", "op_sub", "op_type", "system_op_type", "confirmed_op_type", "draft_op_type",
    "from_time", "to_time", "operation_details",
)


def revision() -> Column:
    return S.row_revision(F.create_map(*[c for f in ROW_FIELDS for c in (F.lit(f), F.col(f))]))


def confirm(
    records: DataFrame, operations: DataFrame, edits: DataFrame, submit: bool, note: str, user: str, now: str, order: tuple[str, ...] = ("type",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply type edits per well: (outcomes, operations, records) as new snapshots.

    ``records.batch`` names the well a report belongs to and is the unit that
    is accepted or refused as a whole.  Edits carry (record_id, row_no, type,
    row_revision); of several valid edits of a row the last by ``order`` applies.
    A well is refused when it has no relevant report, no valid
    edit, any locked report, or an edit of a row that changed since it was read.
    """
    hours = system_hours(operations)
    relevant = records.join(hours.filter("has_non_p"), "record_id", "left_semi")
    kind = F.upper(F.trim("type"))
    valid = (
        edits.withColumn("type", kind)
        .filter(F.col("type").isin("P", "SC", "NPT") & (F.col("row_no") > 0))
        .join(relevant.select("record_id", "batch"), "record_id")
    )
    stored = operations.select("record_id", "row_no", revision().alias("stored_revision"))
    checked = valid.join(stored, ["record_id", "row_no"], "left")
    changed = (F.col("row_revision") != "") & (F.col("stored_revision") != F.col("row_revision"))
    per_edit = checked.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_edits"),
        F.bool_or(F.coalesce(changed, F.lit(False))).alias("changed"),
    )
    per_well = relevant.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n_records"), F.bool_or(S.truthy(F.col("locked"))).alias("any_locked"),
        F.bool_and(S.truthy(F.col("locked"))).alias("all_locked"),
    )
    asked = edits.join(records.select("record_id", "batch"), "record_id").select("batch").distinct()
    outcomes = asked.join(per_well, "batch", "left").join(per_edit, "batch", "left").select(
        "batch",
        F.when(F.col("n_records").isNull(), "not_found")
        .when(F.col("all_locked"), "locked")
        .when(F.col("n_edits").isNull(), "no_valid_rows")
        .when(F.col("any_locked"), "locked")
        .when(F.col("changed"), "changed")
        .otherwise("confirmed" if submit else "draft")
        .alias("outcome"),
    )
    accepted = outcomes.filter(F.col("outcome") == ("confirmed" if submit else "draft"))
    apply = valid.join(accepted, "batch", "left_semi").groupBy("record_id", "row_no").agg(F.max_by("type", F.struct(*order)).alias("_new"))
    edited = operations.join(apply, ["record_id", "row_no"], "left")
    hit = F.col("_new").isNotNull()
    current = F.upper(F.trim("op_type"))

    def swap(name, value):
        return F.when(hit, value).otherwise(F.col(name)).alias(name)

    if submit:
        changes = {
            "confirmed_op_type": F.col("_new"), "op_type": F.col("_new"), "draft_op_type": F.lit(""),
            "system_op_type": S.pick(F.col("system_op_type"), current),
        }
    else:
        changes = {"draft_op_type": F.col("_new"), "system_op_type": S.pick(F.col("system_op_type"), current)}
    new_operations = edited.select(
        *[swap(c, changes[c]) if c in changes else F.col(c) for c in operations.columns]
    )
    marks = relevant.select("record_id", "batch").join(accepted, "batch", "left_semi").select(
        "record_id", F.lit(True).alias("_hit")
    )
    marked = records.join(marks, "record_id", "left")
    fields = {"confirmation_note": F.lit(note), "updated_at": F.lit(now)}
    fields["confirmation_status"] = F.lit("confirmed" if submit else "draft")
    if submit:
        fields["locked"] = F.lit("yes")
    new_records = marked.select(
        *[
            F.when(F.col("_hit"), fields[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in records.columns
        ],
        F.when(F.col("_hit") & F.lit(submit), F.lit(user)).otherwise(F.lit("")).alias("confirmed_by"),
    )
    return outcomes, new_operations, new_records
