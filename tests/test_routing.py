"""Reports routed to tables, files of report lines, translated payloads and a backfill."""

import json

from pyspark.sql import functions as F

from tourlog.operators import merge
from tourlog.sources import payloads, structured

GOOD = {
    "metadata": {"record_id": "R1", "report_type": "move"}, "report_fields": {"wellbore": "W", "rig": "", "reportDate": "d"},
    "operations": [{"hours": "1"}, {"hours": "2", "row_no": "7"}],
}


def test_every_row_has_one_place(spark, tmp_path):
    texts = [("a", json.dumps(GOOD)), ("b", json.dumps(GOOD)[:50]), ("c", ""), ("d", None), ("e", "{}"), ("f", "[1]")]
    routed = structured.route_reports(spark.createDataFrame(texts, "file string, body string"), "file", "body")
    path = str(tmp_path / "out")
    structured.write_routed(routed, path)
    read = lambda table, *columns: sorted(tuple(r) for r in structured.read_table(spark, path, table, list(columns)).collect())
    assert read("operations", "hours") == [("R1", 1, "1"), ("R1", 7, "2")]
    assert read("report_fields", "field", "value") == [("R1", 1, "reportDate", "d"), ("R1", 2, "rig", ""), ("R1", 3, "wellbore", "W")]
    assert read("parse_warnings", "warning") == [("R1", 1, "rig missing")] and read("bulks", "x") == []
    assert [r[0] for r in read("failures", "reason")] == ["b", "c", "d", "e", "f"]


def test_files_of_lines_and_whole_files(spark, tmp_path):
    two = json.dumps(GOOD) + "\n" + json.dumps(GOOD | {"metadata": {"record_id": "R2"}}) + "\n"
    (tmp_path / "a.jsonl").write_text(two)
    (tmp_path / "b.json").write_text(json.dumps(GOOD | {"metadata": {"record_id": "R3"}}, indent=1))
    got = payloads.read_payload_files(spark, str(tmp_path)).select(F.col("metadata")["record_id"]).collect()
    assert sorted(r[0] for r in got) == ["R1", "R2", "R3"]


def test_backfill_goes_on_after_refusals(spark):
    heads = "record_id string, report_type string, wellbore string, locked string"
    rows = "record_id string, module_name string, row_no int, body string"
    stored = spark.createDataFrame([("R1", "move", "old", ""), ("R2", "move", "old", "yes"), ("R3", "move", "old", "")], heads)
    details = spark.createDataFrame([("R1", "operations", 1, "old"), ("R2", "operations", 1, "old"), ("R3", "operations", 1, "old")], rows)
    legacy = [("R1", "move", "first", "", 1), ("R1", "move", "last", "", 2), ("R2", "move", "x", "", 3), ("", "move", "x", "", 4), ("R9", "drilling", "x", "", 5), ("R8", "odd", "x", "", 6)]
    legacy = spark.createDataFrame(legacy, heads + ", ord int")
    news = spark.createDataFrame([(r, m, 1, "new") for r in ("R1", "R2", "R9") for m in ("operations", "notes")], rows)

    def run(kind):
        done = merge.backfill(stored, details, legacy, news, merge.declared_modules(spark), ["ord"], kind)
        return [sorted(tuple(r) for r in frame.collect()) for frame in done]

    records, body, failed = run("")
    assert [(r[0], r[2]) for r in records] == [("R1", "last"), ("R2", "old"), ("R3", "old"), ("R9", "x")]
    assert [(r[0], r[1], r[3]) for r in body] == [("R1", "operations", "new"), ("R2", "operations", "old"), ("R3", "operations", "old"), ("R9", "operations", "new")]
    assert failed == [("R2", "locked"), ("R8", "unsupported report_type")]
    assert [r[0] for r in run("drilling")[0]] == ["R1", "R2", "R3", "R9"] and run("drilling")[2] == []
