"""Ordered operators against plain Python on small random data with one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from tourlog.functions import scalars as S
from tourlog.operators import jobs, ordering


def sample(n=400, seed=5):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.4 else rng.randint(1, 20), rng.randint(0, 300), i) for i in range(n)]


@pytest.mark.parametrize("large", [100_000, 30, 0])
def test_number_rows(spark, monkeypatch, large):
    monkeypatch.setattr(ordering, "LARGE", large)
    rows = sample()
    df = spark.createDataFrame(rows, "k int, o int, i int").withColumn("slice", F.floor(F.col("o") / 16))
    got = {(r.k, r.i): r.n for r in ordering.number_rows(df, ["k"], ["slice"], ["o", "i"], "n").collect()}
    for key in {r[0] for r in rows}:
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), start=1):
            assert got[(key, i)] == n


def test_carry_forward(spark):
    rows = [(k, o, v if v % 7 == 0 else None, i) for i, (k, o, v) in enumerate(sorted({(a, b, c) for a, b, c in sample()}))]
    df = spark.createDataFrame(rows, "k int, o int, v int, i int")
    got = {r.i: r.last for r in ordering.carry_forward(df, ["k"], "o", F.col("v"), "last", block=8, ties=["i"]).collect()}
    for key in {r[0] for r in rows}:
        last = None
        for _, _, v, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[3])):
            last = v if v is not None else last
            assert got[i] == last


def test_neighbours(spark):
    df = spark.createDataFrame([("a", n, f"t{n}") for n in range(1, 6)], "k string, n int, t string")
    got = {r.n: (r.before, r.after) for r in ordering.neighbours(df, ["k"], "n", {"before": ("t", -1), "after": ("t", 1)}).collect()}
    assert got[1] == (None, "t2") and got[3] == ("t2", "t4") and got[5] == ("t4", None)


def test_clock_length_equals_running_clock(spark):
    """The row formula equals the fold over a report with its running clock."""
    rng = random.Random(11)
    rows = []
    for record in range(60):
        for n in range(rng.randint(1, 12)):
            clock = lambda: rng.choice(["xx", "24:00", f"{rng.randint(0, 23)}:{rng.choice(['00', '15', '30', '45'])}"])
            rows.append((record, n, clock(), clock(), rng.choice(["24", "3.5", "0"])))
    df = spark.createDataFrame(rows, "r int, n int, a string, b string, h string")
    length = S.clock_hours(S.clock_minutes(F.col("a")), S.clock_minutes(F.col("b")), S.safe_float(F.col("h")))
    got = {(x.r, x.n): x.d for x in df.select("r", "n", length.alias("d")).collect()}

    def minutes(text):
        if ":" not in text:
            return None
        h, m = map(int, text.split(":"))
        return h * 60 + m

    for record in range(60):
        clock = 0
        for r, n, a, b, h in rows:
            if r != record:
                continue
            start, end = minutes(a), minutes(b)
            if start is None or end is None:
                assert got[(r, n)] is None
                continue
            shift = max(0, -(-(clock - start) // 1440))
            begin = start + shift * 1440
            stop = end + begin // 1440 * 1440
            stop += max(0, -(-(begin - stop) // 1440)) * 1440
            if stop == begin and float(h) >= 23.9:
                stop += 1440
            assert got[(r, n)] == (stop - begin) / 60
            clock = stop


def test_signature_sees_edits_not_order(spark):
    base = [("r", n, f"t{n}") for n in range(5)]
    sign = lambda rows: jobs.signature(spark.createDataFrame(rows, "k string, n int, t string"), "k", "n", "t").first().signature
    assert sign(base) == sign(list(reversed(base)))
    assert sign(base) != sign(base[:-1] + [("r", 4, "other")])
    assert sign(base) != sign([("r", n, f"t{4 - n}") for n in range(5)])


def test_messages_are_cut_like_the_joined_text(spark):
    rows = [("r", n, f"message {n % 120:03d}") for n in range(600)] + [("s", 1, "only")]
    df = spark.createDataFrame(rows, "record_id string, n int, m string")
    got = {r.record_id: r.error for r in jobs.first_messages(df, "record_id", "m", "n").collect()}
    whole = "; ".join(dict.fromkeys(m for k, _, m in rows if k == "r"))[:500]
    assert got == {"r": whole, "s": "only"}


def test_rows_of_small_keys_move_once(spark):
    df = spark.range(1000).selectExpr("id % 50 as k", "id as o", "if(id % 9 = 0, id, null) as v", "repeat('x', 50) as text")
    number = ordering.number_rows(df, ["k"], ["o"], ["o"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in number and "Join Inner" in number.split("Union")[1] and "Join LeftOuter" in number
    plan = ordering.carry_forward(df, ["k"], "o", F.col("v"), "last")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
