"""Registered queries against their check SQL on the smallest tables.

A broad sample by default; all of them with TOURLOG_ALL=1.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "npt_by_rig", "production_kpis", "production_details", "project_report", "project_assignment", "missing_dates", "fact_operations",
    "npt_wells", "npt_confirm", "validation_warnings", "clock_durations", "upsert_records", "replace_detail_rows", "save_memory",
    "requeue_on_change", "text_units", "memory_lookup", "coverage", "greedy_chunks", "glossary_match", "terms_import_diff", "qa_report",
    "failure_families", "merge_suggestions", "extract_party", "grid_fields", "text_operation_rows", "log_retention",
    "report_arrival_stream", "load_payloads", "protected_spans", "restore_by_token", "terms_import_batch", "split_text_parts",
    "structured_tables", "preserve_terms", "layout_blocks", "layout_stock", "layout_survey",
]
NAMES = list(entry.queries()) if os.environ.get("TOURLOG_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    status, detail, _, _ = compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows-only"), f"{status} {detail}"


def test_every_check_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["label", "hours"]
