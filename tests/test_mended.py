"""Cases that once gave wrong answers."""

from pyspark.sql import functions as F

from tourlog.functions import text
from tourlog.operators import documents, ordering
from tourlog.streaming import jobs


def test_numbers_of_any_number_of_groups(column):
    got = column(text.number_tokens, ["1,234,567,890,123,456,789 m", "12,345 and 7,5", "1,2345", "1,234", "a 999, 000"])
    assert got == [["1234567890123456789"], ["12345", "7.5"], ["1,2345"], ["1234"], ["999000"]]


def test_addresses_of_three_letters(spark):
    cells = spark.createDataFrame([("d", "s", 1, c, "x") for c in (0, 25, 26, 701, 702, 728, 16383)], "doc string, sheet string, row int, col int, value string")
    got = {r.address for r in documents.raw_cells(cells).collect()}
    assert got == {"A1", "Z1", "AA1", "ZZ1", "AAA1", "ABA1", "XFD1"}


def test_null_keys_are_numbered(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 3)], "k string, v int")
    got = ordering.number_rows(rows, ["k"], ["v"], ["v"]).collect()
    assert sorted((r.k or "", r.v or 0, r.row_no) for r in got) == [("", 1, 1), ("", 2, 2), ("a", 0, 1), ("a", 3, 2)]



def test_stream_over_a_folder_of_parts(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "t.parquet"))
    stream = jobs.parquet_stream(spark, str(tmp_path), "t.parquet", spark.range(1).schema)
    assert jobs.run_to_table(stream, "append", "parts").select(F.sum("id")).first()[0] == 45


def test_report_lines_are_written_packed(spark, tmp_path, monkeypatch):
    from tourlog.plans import event_queries
    from tourlog.plans.registry import QUERIES, Inputs

    monkeypatch.setattr(event_queries, "shared_dir", lambda session, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(event_queries, "REPORTS_PER_FILE", 500, raising=False)
    rows = QUERIES["json_lines_source"](Inputs(spark, "/root/testdata/sf0.001"))
    files = [f.name for f in (tmp_path / "reports").glob("part-*")]
    assert len(files) >= 3 and all(f.endswith(".gz") for f in files)
    assert rows.select("record_id").distinct().count() > 1000


def test_failures_read_no_text_twice(spark):
    """Spark's filter for an exploded list would read every error once more; families are hashed, not failures."""
    from tourlog.operators import failures

    rows = spark.createDataFrame(
        [("R1", 1, "drilling", "f", "s", "protected term; MISSING=['ROP', 'A|C']"), ("r1", 2, "drilling", "f", "s", "unit lost; missing=[]"), ("R2", 3, "move", "f", "s", None)],
        "record_id string, row_no int, report_type string, field_code string, source_text string, error_message string",
    )
    known = spark.createDataFrame([("acronym", "rop")], "kind string, value string")
    issues = failures.classify(rows, known)
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(error_message") == 1 and "RLIKE" not in plan
    got = sorted((r.record_id, r.category, r.token) for r in issues.collect())
    assert got == [
        ("R1", "missing_protected_acronym", "A|C"), ("R1", "protected_term_regression", "ROP"),
        ("R2", "semantic_or_completeness", ""), ("r1", "semantic_or_completeness", ""),
    ]
    plan = failures.evidence(issues)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") < plan.index("Window ")


def test_suggestions_are_verified_from_one_reading_of_the_pool(spark, tmp_path):
    from tourlog.operators import failures

    rows = [("f1", "APPLIED", ["a", "b", ""]), ("f2", "APPLIED", ["a", "c"]), ("f3", "APPLIED", ["b"]), ("f4", "APPLIED", None), ("f5", "QUEUED", ["a"]), ("f6", "APPLIED", ["x"])]
    spark.createDataFrame(rows, "fingerprint string, status string, record_ids array<string>").write.parquet(str(tmp_path / "pool"))
    pool = spark.read.parquet(str(tmp_path / "pool"))
    states = spark.createDataFrame([("a", "COMPLETED"), ("b", "COMPLETED"), ("c", "PENDING"), ("f4", "COMPLETED")], "record_id string, status string")
    done = spark.createDataFrame([("a",), ("f4",)], "record_id string")
    out = failures.verify_suggestions(pool, states, done, "now")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert out.columns == [*pool.columns, "verified_record_id", "verified_at"]
    got = {r.fingerprint: (r.status, r.record_ids, r.verified_record_id, r.verified_at) for r in out.collect()}
    assert got == {k: (("VERIFIED" if k == "f1" else s), ids, "a" if k == "f1" else "", "now" if k == "f1" else "") for k, s, ids in rows}


def test_pairs_of_many_partitions_are_cut_into_short_tasks(spark):
    from tourlog.plans import language_queries  # noqa: F401
    from tourlog.plans.registry import VIEWS, Inputs

    names = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        inputs = Inputs(spark, "/root/testdata/sf0.001")
        given = inputs.t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").rdd.getNumPartitions()
        pairs = VIEWS["pairs"](inputs)
        assert given >= 4 and pairs.rdd.getNumPartitions() >= 8 * given
        assert pairs.count() == inputs.t("orders").count()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
