"""Secrets in texts, found by one automaton for all rules.

The rules are compiled once on the driver (a table of bounded size that only
depends on them) and sent to the workers; texts are scanned where they are
read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.llm.automaton import Automaton, Rule
from tourlog.llm.words import contents, pieces

# Base rules.  A run of hexadecimal digits ends where it ends, however many of them
# the pattern asks for; eight keep plain words from being looked at, and few states.
BASE_RULES = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 8, fold=True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 12),
    Rule("hex", "", r"[0-9a-f]{8,}", 32),
]
# Prefixes that issuers of keys document
MORE_RULES = [
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("stripe", r"[sr]k_live_", r"[A-Za-z0-9]+", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
RULES = BASE_RULES + MORE_RULES

_CONTINUED = (np.arange(256) & 0xC0) == 0x80


def text_spans(automaton: Automaton, text: bytes) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points; all patterns are ASCII, so no span cuts a character."""
    found = automaton.spans(text)
    if found and not text.isascii():
        points = np.concatenate([[0], np.cumsum(~_CONTINUED[np.frombuffer(text, np.uint8)])])
        found = [(int(points[s]), k, int(points[e])) for s, k, e in found]
    return found


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end), by start, then kind as listed.

    Offsets are code points of the whole text, the end is exclusive.  Matches of
    one rule are leftmost and do not overlap; those of different rules may.  A null
    or empty text has no secrets; repeated rows each have their own; an empty
    table gives an empty one.  A column named ``secrets`` is replaced.
    """
    automaton = Automaton(rules or RULES)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    names = [c for c in docs.columns if c != "secrets"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        listed = [r.kind for r in scan.rules]
        for b in pieces(batches):
            rows = [
                [{"kind": listed[k], "start": s, "end": e} for s, k, e in text_spans(scan, t)]
                for t in contents(b.column(b.schema.get_field_index("text")))
            ]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(rows, pa.list_(item))], [*names, "secrets"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in names) + "secrets array<struct<kind string, start bigint, end bigint>>"
    return docs.select(*names).mapInArrow(run, schema)


def listed(secrets: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, secrets: Column, mask: str = "*") -> Column:
    """``text`` with every character of a secret masked; overlapping spans count once."""
    step = F.aggregate(
        secrets,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.concat(
                acc["done"],
                F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")),
                F.repeat(F.lit(mask), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)).cast("int")),
            ).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
    )
    return F.concat(step["done"], F.substring(text, (step["at"] + 1).cast("int"), F.lit(2**31 - 1)))
