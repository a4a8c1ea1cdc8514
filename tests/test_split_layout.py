"""Cutting of texts at layout and sentence marks, against the plain scan."""

import random
import re

from pyspark.sql import functions as F

from tourlog.functions import text as X
from tourlog.operators import textunits as T

MARKS = (". ", "; ", "? ", "! ", " -", " +", " *")


def plain_line(line, most):
    """Pieces of a line with the blank, or nothing, before each."""
    out, before = [], ""
    while len(line) > most:
        window = line[: most + 1]
        at = max(window.rfind(m) for m in MARKS)
        if at < most // 2:
            at = window.rfind(" ")
        at = most if at <= 0 else at + 1
        out.append((before, line[:at].strip()))
        before = " " if " " in (line[at - 1], line[at]) else ""
        line = line[at:].strip()
    return out + [(before, line)]


def plain_parts(text, most):
    if len(text) <= most:
        return [("", text)]
    parts, gap = [], ""
    for token in re.split(r"(\n+)", text):
        if token.startswith("\n"):
            gap = token
            continue
        for n, (before, piece) in enumerate(plain_line(token, most)):
            separator = gap if n == 0 else before
            if parts and len(parts[-1][1]) + len(separator) + len(piece) <= most:
                parts[-1] = parts[-1][0], parts[-1][1] + separator + piece
            else:
                parts.append((separator if parts else "", piece))
    return parts


def test_parts_equal_the_scan(spark):
    rng = random.Random(4)
    bits = ["word", "a", "end. ", "why? ", "; ", " - item", " +", " * ", "\n", "\n\n", " ", " ", "x" * 30, "é́", "\t", "!", "日本"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(300)] + ["", None, " ", "x" * 500, "a b " * 5000, "line\n" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for most in (10, 24, 61):
        for r in rows.select(X.multiline(F.col("t")).alias("tidy"), T.split_layout(F.col("t"), most).alias("p")).collect():
            got = [tuple(p) for p in r.p]
            assert got == plain_parts(r.tidy, most)
            assert all(len(text) <= most for _, text in got) and "".join(s + t for s, t in got) == r.tidy


def test_translated_parts_keep_their_lines(spark):
    source = "INTRO:\n- FIRST ITEM.\n- SECOND ITEM.\n\nFINAL OPERATION."
    row = spark.createDataFrame([(source,)], "t string").withColumn("p", T.split_layout(F.col("t"), 24))
    said = F.transform("p", lambda p: F.replace(F.replace(p["text"], F.lit("ITEM"), F.lit("项目")), F.lit("FINAL OPERATION"), F.lit("最终操作")))
    out = row.select(T.join_layout(F.col("p"), said)).first()[0]
    assert out == "INTRO:\n- FIRST 项目.\n- SECOND 项目.\n\n最终操作."
