"""Literal report examples."""

import pytest
from pyspark.sql import functions as F

from tourlog.operators import assignment as A
from tourlog.operators import production as P
from tourlog.operators import quality as Q
from tourlog.operators import textunits as T

BINDING = (
    "project_id string, project_contract string, project_title string, project_status string, project_start string, project_end string, "
    "rig string, rig_start string, rig_end string, wells array<string>"
)
REPORT = (
    "record_id string, rk int, report_type string, report_date string, wellbore string, rig string, event string, updated_at string, "
    "validation_status string, afe_number string"
)


def windows(spark, wells):
    rows = [("p1", "EC-2026-001", "Test Project", "active", "2026-01-01", "2026-12-31", "ACME 248", "2026-07-01", "2026-07-31", wells)]
    teams = spark.createDataFrame([(0, "ACME 248"), (0, "RIG 248"), (1, "RIG 248"), (1, "OTHER")], "team_ord int, name string")
    return A.project_windows(spark.createDataFrame(rows, BINDING), teams)


def report(n, kind, date, well="W-040", rig="ACME 248", event="", status="ok"):
    return (f"R{n}", n, kind, date, well, rig, event, "", status, "AFE-001")


@pytest.mark.parametrize(
    "date,well,rig,hits",
    [
        ("2026-07-15", "W-040", "ACME 248", 1), ("2026-07-15", "W-041", "ACME 248", 0), ("2026-08-01", "W-040", "ACME 248", 0),
        ("2026-07-15", "W-040", "RIG 248", 1), ("2026-07-15", "W-040", "OTHER", 0), ("bad", "W-040", "ACME 248", 0),
    ],
)
def test_assignment(spark, date, well, rig, hits):
    rows = spark.createDataFrame([report(1, "drilling", date, well, rig)], REPORT)
    assert A.assign_projects(rows, windows(spark, ["W-040"])).count() == hits


def test_project_report_dates_and_hours(spark):
    reports = [report(1, "drilling", "2026-06-01", event="Rig Move")]
    reports += [report(n, "drilling", f"2026-06-0{n}", event="DEV DRILLING") for n in range(2, 6)]
    reports += [report(6, "completion", "2026-06-11"), report(7, "workover", "2026-06-12", event="WORKOVER", status="warning")]
    records = spark.createDataFrame(reports, REPORT)
    for c, v in (("project_id", "p1"), ("project_name", "Test Project"), ("project_contract", "EC-2026-001")):
        records = records.withColumn(c, F.lit(v))
    hours = spark.createDataFrame([(f"R{n}", 12.0, 1.0) for n in range(1, 8)], "record_id string, total_h double, npt_h double")
    remarks = spark.createDataFrame([("p1|ACME 248|W-040", "seen")], "remark_key string, remarks string")
    row = P.project_report(records.join(hours, "record_id"), remarks, "ACME").collect()
    assert len(row) == 1
    row = row[0]
    assert (row.move_date, row.drilling_start_date, row.drilling_finish_date) == ("2026-06-01", "2026-06-02", "2026-06-05")
    assert (row.completion_date, row.workover_date) == ("2026-06-11", "2026-06-12")
    assert (row.drilling_hours, row.completion_hours, row.workover_hours, row.npt_hours) == (60.0, 12.0, 12.0, 7.0)
    assert (row.contract_project, row.status, row.remarks) == ("EC-2026-001 / Test Project", "有告警", "seen")


def test_npt_ranking_keeps_zero_rigs(spark):
    facts = spark.createDataFrame(
        [("RIG A", 2.0, 1), ("RIG B", 0.0, 0), ("", 0.0, 0)], "rig string, npt_h double, n_npt int"
    )
    assert [tuple(r) for r in P.npt_by_rig(facts).collect()] == [("RIG A", 2.0), ("RIG B", 0.0)]


def test_export_order_of_empties(spark):
    rows = spark.createDataFrame([("b",), ("",), ("a",), (None,)], "v string")
    down = [r.v for r in P.sort_export(rows, "v", "desc", ()).collect()]
    assert down[2:] == ["b", "a"] and set(down[:2]) == {"", None}
    assert [r.v for r in P.sort_export(rows, "v", "asc", ()).collect()][:2] == ["a", "b"]


def warnings_of(spark, operations, kind="drilling"):
    records = spark.createDataFrame([("R1", kind)], "record_id string, report_type string")
    rows = spark.createDataFrame(
        [("R1", n, *row) for n, row in enumerate(operations, start=1)],
        "record_id string, row_no int, from_time string, to_time string, hours string, op_code string, op_type string, operation_details string",
    )
    return sorted(r.warning for r in Q.operation_warnings(rows, records).collect())


def test_clock_rule(spark):
    assert warnings_of(spark, [("00:00", "08:00", "7.5", "A", "P", "x")]) == ["operations row 1 time duration mismatch"]
    assert warnings_of(spark, [("06:00", "06:00", "24", "A", "P", "x")]) == []
    blank = warnings_of(spark, [("06:00", "07:00", "", "A", "SC", "x")])
    assert blank == ["operations row 1 hours missing", "operations row 1 hours out of range", "operations row 1 type invalid"]


def test_interval_rules(spark):
    heads = spark.createDataFrame([("R1", "workover")], "record_id string, report_type string").withColumn(
        "fields", F.create_map(F.lit("todayMd"), F.lit(""))
    )
    names = "md incl dls od id joints length top_md base_md density phase penetration diameter".split()
    values = {"top_md": "1200", "base_md": "1100", "density": "-1"}
    rows = spark.createDataFrame(
        [("R1", 1, "perforation_intervals", *[values.get(n, "") for n in names])],
        "record_id string, row_no int, module_name string, " + ", ".join(f"{n} string" for n in names),
    )
    got = sorted(r.warning for r in Q.detail_warnings(rows, heads).collect())
    assert got == ["perforation_intervals row 1 base_md less than top_md", "perforation_intervals row 1 density negative"]


def test_unchanged_translations(column):
    error = lambda c: T.unchanged_error(F.lit("PERFORA HASTA 100 PIES HOY"), c)
    same = "source text was returned unchanged"
    got = column(error, ["perfora  hasta 100\npies hoy", "PERFORA HASTA 100 PIES HOY ok", "钻进", " "])
    assert got == [same, same, "", "missing translated_text"]


def test_long_texts_split_without_loss(column):
    text = " ".join(f"Sentence number {n} goes on." for n in range(200))
    parts = column(lambda c: T.split_parts(c, 120), [text])[0]
    assert max(map(len, parts)) <= 120 and " ".join(parts) == text
    hard = column(lambda c: T.split_parts(c, 50), ["x" * 173])[0]
    assert "".join(hard) == "x" * 173 and max(map(len, hard)) <= 50
