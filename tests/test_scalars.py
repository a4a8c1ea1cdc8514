from pyspark.sql import functions as F

from tourlog.functions import scalars as S
from tourlog.functions import text as X


def test_safe_float(column):
    values = ["1,234.5", "", None, "abc", " 7 ", "1d", "-3", "1e2", ".5", "5."]
    assert column(S.safe_float, values) == [1234.5, 0.0, 0.0, 0.0, 7.0, 0.0, -3.0, 100.0, 0.5, 5.0]


def test_effective_type_prefers_untrimmed_values(spark):
    rows = spark.createDataFrame(
        [("", "P", "NPT"), ("npt ", "P", ""), ("", "", "sc"), (" ", "P", "P"), ("", "", "")], "c string, o string, s string"
    )
    got = rows.select(S.effective_op_type(F.col("c"), F.col("o"), F.col("s"))).collect()
    assert [r[0] for r in got] == ["P", "NPT", "SC", "", ""]


def test_rig_names(column):
    names = ["00 ACME 248", "acme-248", "ACME248", "ACME  248", "OTHER 9", "TEST placeholder", "n/a", ""]
    assert column(lambda c: S.canonical_rig(c, "ACME"), names)[:5] == ["ACME 248"] * 4 + ["OTHER 9"]
    assert column(lambda c: S.valid_rig(S.canonical_rig(c, "ACME")), names) == [True] * 5 + [False] * 3


def test_natural_record_id(spark):
    rows = spark.createDataFrame([("drilling", "W 1/2", "2026-07-01", "#7"), ("move", " ", "2026-07-01", "1")], "a string, b string, c string, d string")
    got = [r[0] for r in rows.select(S.natural_record_id(*[F.col(c) for c in "abcd"])).collect()]
    assert got == ["drilling:W-1-2:2026-07-01:7", ""]


def test_dates(column):
    texts = ["2026-7-5", "07/15/2026", "31/12/2025", "2026/02/30", "05-12-2025", "12-25-2025", "2027-01-01", "", "x"]
    got = column(lambda c: S.normalize_date(c, F.lit("d"), "2026-12-31"), texts)
    assert [r.value for r in got] == ["2026-07-05", "2026-07-15", "2025-12-31", "2026/02/30", "2025-12-05", "2025-12-25", "2027-01-01", "", "x"]
    assert [r.warning for r in got] == ["", "", "", "d date invalid", "", "", "d is in the future", "", "d date invalid"]


def test_times_and_numbers(column):
    got = column(lambda c: S.normalize_time(c, F.lit("t")), ["7:05", "23：59", "24:00", "24:01", "7h", ""])
    assert [r.value for r in got] == ["07:05", "23:59", "24:00", "24:01", "7h", ""]
    numbers = column(lambda c: S.normalize_number(c, F.lit("n")), ["1,200.50", "8.5 ppg", "about 5 psi", "none", "10.00", "-0.0"])
    assert [r.value for r in numbers] == ["1200.5", "8.5", "5", "none", "10", "-0"]
    assert [r.warning for r in numbers] == ["", "", "n number corrected", "n number invalid", "", ""]


def test_field_splitting(column):
    assert column(lambda c: S.value_between(c, "Today's MD:", "Progress:"), ["Today's MD: 9,100 ft  Progress: 5", "none"]) == ["9,100 ft", ""]
    assert column(lambda c: S.split_slash(c, 3), ["a / b"]) == [["a", "b", ""]]
    assert [tuple(r) for r in column(lambda c: S.split_at(c, "@"), ['9 5/8" @ 120', "x"])] == [('9 5/8"', "120"), ("x", "")]
    assert column(lambda c: S.date_from_slashes(c, day_first=True), ["on 5/12/2025"]) == ["2025-12-05"]


def test_ocr_repairs(column):
    cases = {
        "FILTRA1700": "FILTRA 1700", "9 58/IN": "9 5/8IN", '12.1/4"': '12 1/4"', '12 ¼"': '12 1/4"', "8, 668'": "8,668'",
        "HEDRON1700": "HEDRON1700", "9.937'": "9.937'", '8\n1/2"': '8 1/2"',
    }
    assert column(X.repair_ocr, list(cases)) == list(cases.values())


def test_multiline_layout(column):
    assert column(X.multiline, [" \r\nINTRO:\t \r\n-  ITEM ONE.\r\n\r\nFINAL  \r\n\r\n"]) == ["INTRO:\n- ITEM ONE.\n\nFINAL"]


def test_languages(column):
    texts = ["钻进至 100", "perfora hasta 100", "Presión alta", "drilled to 100", ""]
    assert column(X.detect_language, texts) == ["zh-CN", "es", "es", "en", "en"]
    assert column(lambda c: X.needs_translation(c, "zh-CN"), ["drill ahead", "ROP", "12 [[P1]]", "a b c d"]) == [True, False, False, False]
    assert column(X.technical_literal, ["BHA 5 x 7", "drill", "#7", "DRILLING"]) == [True, False, True, False]


def test_number_tokens(column):
    texts = ["5,923", "5923", '2,25"', '2.25"', "9.937' MD", "9937", "12 ¼", "12 1/4", "#1", "#01", "FILTRA1700 y BHA3", '9 58/IN', "1,234,567 m"]
    got = column(X.number_tokens, texts)
    assert got == [["5923"], ["5923"], ["2.25"], ["2.25"], ["9937"], ["9937"], ["12 1/4"], ["12 1/4"], ["1"], ["1"], ["1700"], ["9 5/8"], ["1234567"]]


def test_calendar_dates(column):
    texts = ["el 14 de mayo de 2026 y 3 de junio", "July 4, 2025", "05/12/2025", "2025-12-05", "99/99/2025"]
    got = [[(d.year, d.month, d.day) for d in dates] for dates in column(X.calendar_dates, texts)]
    assert got == [[(2026, 5, 14), (0, 6, 3)], [(2025, 7, 4)], [(2025, 12, 5)], [(2025, 12, 5)], []]


def test_parties(spark, column):
    texts = ["x\nNPT A CARGO DE ACME; espera", "Responsible party: DRILLCO during trip", "nothing"]
    assert column(X.explicit_party, texts) == ["ACME", "DRILLCO", ""]
    rows = spark.createDataFrame([("ACME", "ACME 248"), ("Vendor.", "ACME 248"), ("n/a", "x")], "v string, rig string")
    assert [r[0] for r in rows.select(X.normalize_party(F.col("v"), F.col("rig"))).collect()] == ["ACME 248", "VENDOR", ""]


def test_party_by_cause(column):
    from tourlog.operators.extraction import evidence_party

    aliases = ((r"\bSPERRY\b", "SPERRY SERVICES"), (r"\bACME[- /]+SLB\b", ""))
    texts = ["FALLA en herramienta SPERRY", "SPERRY a bordo", "washout en tubo", "falla ACME / SLB"]
    assert column(lambda c: evidence_party(c, aliases), texts) == ["SPERRY SERVICES", "", "", "ACME-SLB"]


def test_revision_ignores_key_order(spark):
    a = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    b = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    row = spark.range(1).select(S.row_revision(a).alias("a"), S.row_revision(b).alias("b")).first()
    assert row.a == row.b
