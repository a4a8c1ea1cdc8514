"""Structure repair of conversations by the lightest derivation.

The turns of a conversation, in order, are edited until their roles read
``(system? (user assistant)+)?``.  An item (i, state) stands for the best way to
finish from turn i with the roles in that state; its weight is (cost, edits).
Deductions put one edit before a finished item: Keep, Rerole, Delete or Insert.
They are superior functions in the order (cost, turns done, edits): an edit costs
something, or does one more turn.  So Knuth's agenda pops every item once, with
its final weight, and stops when the goal, turn 0 with no role yet, is popped.
Edits are put in front, so that of equally long ends the alphabetically first
stays first.

A conversation of many turns is cut into slices of SLICE turn numbers.  A slice
gets the lightest derivations from each state to each state; these compose, as no
audit of a slice is the beginning of another one of equal cost.  Turns and texts
cross the network once, those of cut conversations twice.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.llm.storage import written

# turn numbers of a slice
SLICE = 1024
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
# how each state may be reached by a turn of this role
STEPS = {"s": [(EMPTY, SYSTEM)], "u": [(EMPTY, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
# what a role's first letter makes of a state
AFTER = {("s", EMPTY): SYSTEM} | {(r, p): q for r in "ua" for p, q in STEPS[r]}
NEEDED = {EMPTY: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
# edits after the last turn that end in an accepted state
CLOSING = {EMPTY: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\v\f\r"

# (first letter of the role, has to go, is truncated)
Turn = tuple[str, bool, bool]
Weight = tuple[int, str]


def lightest(turns: list[Turn], ends: dict[int, Weight], goal: int | None = EMPTY) -> dict[int, Weight]:
    """Weights of (0, state) for the states found until ``goal`` is; all of them if it is None.

    ``ends`` are the weights of the items after the last turn.
    """
    n = len(turns)
    agenda = [(cost, 0, audit, n, state) for state, (cost, audit) in ends.items()]
    heapq.heapify(agenda)
    done: set[tuple[int, int]] = set()
    found: dict[int, Weight] = {}
    while agenda:
        cost, _, audit, i, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == 0:
            found[state] = cost, audit
            if state == goal:
                break
        for role in "ua":
            for before, after in STEPS[role]:
                if after == state and (i, before) not in done:
                    heapq.heappush(agenda, (cost + INSERT, n - i, "I" + audit, i, before))
        if not i:
            continue
        first, must_go, cut = turns[i - 1]
        at = n - i + 1
        heapq.heappush(agenda, (cost + DELETE, at, "D" + audit, i - 1, state))
        if must_go:
            continue
        for role, steps in STEPS.items():
            for before, after in steps:
                if after == state and (i - 1, before) not in done:
                    if role == first:
                        heapq.heappush(agenda, (cost + TRUNCATED * cut, at, "K" + audit, i - 1, before))
                    elif role != "s":
                        heapq.heappush(agenda, (cost + TRUNCATED * cut + REROLE, at, "R" + audit, i - 1, before))
    return found


def between(turns: list[Turn]) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, audit) of a slice."""
    return [(p, q, cost, audit) for q in CLOSING for p, (cost, audit) in lightest(turns, {q: (0, "")}, None).items()]


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> list[dict]:
    """The turns that ``audit`` makes of ``rows`` (role, text)."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            role, text = NEEDED[state], ""
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = NEEDED[state]
        state = AFTER[role[0], state]
        out.append({"edit": edit, "role": role, "text": text})
    return out


ITEM = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
PATH = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
COUNTS = ["blank", "duplicate", "truncated", "illegal", "n_turns", "min_turn", "max_turn"]


def _facts(rows: list[tuple], seen: set) -> tuple[list[Turn], dict]:
    """Of rows (turn, role, text): what the agenda needs, and the counts of a slice; ``seen`` holds earlier (role, text)."""
    turns, count = [], dict.fromkeys(COUNTS, 0)
    for turn, role, text in rows:
        body = text.rstrip(WHITE)
        blank = not body.lstrip(WHITE)
        duplicate = not blank and (role, text) in seen
        cut = not blank and not duplicate and body[-1] not in ".!?"
        seen.add((role, text))
        count["blank"] += blank
        count["duplicate"] += duplicate
        count["truncated"] += cut
        turns.append((role[:1], blank or duplicate, cut))
    count["illegal"] = sum(x[0] + y[0] not in LEGAL for x, y in zip(turns, turns[1:]))
    numbers = [r[0] for r in rows if r[0] is not None]
    count |= {"n_turns": len(set(numbers)), "min_turn": min(numbers, default=None), "max_turn": max(numbers, default=None)}
    return turns, count


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns, one group in memory at a time."""
    held, rows = None, []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns]):
            if row[:keys] != held:
                if rows:
                    yield held, rows
                held, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield held, rows


def _batches(rows: Iterator[tuple[int, list]], types: list[tuple[str, pa.DataType]], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows with their sizes, of ``limit`` characters or little more."""

    def batch(kept: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*kept), types)], [n for n, _ in types])

    kept, size = [], 0
    for extra, row in rows:
        kept.append(row)
        size += extra + 200
        if size > limit:
            yield batch(kept)
            kept, size = [], 0
    if kept:
        yield batch(kept)


def _sorted(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _prepared(turns: DataFrame) -> DataFrame:
    """conv_id, slice, kind 2, turn, role, text; turns without number come first, in a slice of their own."""
    none = F.lit(-(2**63)).cast("bigint")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / SLICE).cast("bigint"), none).alias("slice"), F.lit(2).alias("kind"),
        F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"),
    )


def _same(left: str, right: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of conversations with more than one slice."""
    many = rows.groupBy("conv_id").agg(F.min("slice").alias("low"), F.max("slice").alias("high")).where("low < high").select("conv_id")
    return rows.alias("r").join(many.alias("m"), _same("r", "m", "conv_id"), "left_semi")


def slice_repairs(turns: DataFrame) -> DataFrame:
    """One row per slice: counts, then cost, audit and repaired turns if it is the whole conversation, else its paths.

    Rows are ordered by turn (null first), then role and text after nulls became
    one space.
    """
    rows = _prepared(turns)
    parts = _cut(rows.select("conv_id", "slice")).distinct()
    texts = _cut(rows).select("conv_id", "slice", "role", "text").distinct()
    earliest = texts.groupBy("conv_id", "role", "text").agg(F.min("slice").alias("slice"))
    seen = texts.alias("t").join(earliest.alias("e"), _same("t", "e", "conv_id", "role", "text")).where("t.slice > e.slice").select("t.*")
    none = [F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")]
    marks = parts.select("conv_id", "slice", F.lit(0).alias("kind"), *none)
    marks = marks.unionByName(seen.select("conv_id", "slice", F.lit(1).alias("kind"), none[0], "role", "text"))
    types = [("slice", pa.int64()), ("many", pa.bool_()), *[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string())]
    types += [("cost", pa.int64()), ("audit", pa.string()), ("paths", pa.list_(PATH)), ("repaired", pa.list_(ITEM))]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        for (conv, part), group in _groups(batches, 2):
            many = group[0][0] == 0
            seen = {(r[2], r[3]) for r in group if r[0] == 1}
            own = [r[1:] for r in group if r[0] == 2]
            facts, count = _facts(own, seen)
            ends = [facts[0][0], facts[-1][0]]
            head = [conv, part, many, *count.values(), *ends]
            if many:
                paths = [dict(zip(("from", "to", "cost", "audit"), x)) for x in between(facts)]
                yield 4 * len(own), [*head, None, None, paths, None]
            else:
                cost, audit = lightest(facts, CLOSING)[EMPTY]
                yield sum(len(r[2]) for r in own), [*head, cost, audit, None, edited([r[1:] for r in own], audit, EMPTY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            chain = (b for bs in ([first], batches) for b in bs)
            yield from _batches(found(chain), [("conv_id", first.schema.field(0).type), *types])

    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, slice bigint, many boolean, "
    schema += ", ".join(f"{c} bigint" for c in COUNTS) + ", first string, last string, cost bigint, audit string, "
    schema += "paths array<struct<`from`: int, `to`: int, cost: bigint, audit: string>>, repaired array<struct<edit: string, role: string, text: string>>"
    return _sorted(rows.unionByName(marks), ["conv_id", "slice"], ["kind", "turn", "role", "text"]).mapInArrow(run, schema)


def chosen_paths(slices: DataFrame) -> DataFrame:
    """Of slices of cut conversations: the state each begins in, its part of the audit and cost, and an illegal pair before the next."""
    types = [("slice", pa.int64()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("border", pa.int64())]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        for (conv,), group in _groups(batches, 1):
            # from the last slice to the first: the best way on from each state, and the path it takes now
            best, ways, after = dict(CLOSING), [], None
            for part, first, last, paths in group:
                new = {}
                for path in paths:
                    p, q = path["from"], path["to"]
                    weight = path["cost"] + best[q][0], path["audit"] + best[q][1]
                    if p not in new or weight < new[p][0]:
                        new[p] = weight, (q, path["cost"], path["audit"])
                ways.append((part, {p: way for p, (_, way) in new.items()}, after is not None and last + after not in LEGAL))
                best, after = {p: weight for p, (weight, _) in new.items()}, first
            state = EMPTY
            for k in range(len(ways) - 1, -1, -1):
                part, way, border = ways[k]
                to, cost, audit = way[state]
                if k == 0:
                    cost, audit = cost + CLOSING[to][0], audit + CLOSING[to][1]
                yield len(audit), [conv, part, state, cost, audit, int(border)]
                state = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            chain = (b for bs in ([first], batches) for b in bs)
            yield from _batches(found(chain), [("conv_id", first.schema.field(0).type), *types])

    kept = slices.where("many").select("conv_id", "slice", "first", "last", "paths")
    schema = f"conv_id {slices.schema['conv_id'].dataType.simpleString()}, slice bigint, state int, cost bigint, audit string, border bigint"
    return _sorted(kept, ["conv_id"], [F.desc("slice")]).mapInArrow(run, schema)


def _applied(turns: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, slice, repaired: the turns of cut conversations under their chosen paths."""
    rows = _cut(_prepared(turns))
    none = F.lit(None).cast("bigint").alias("turn")
    marks = chosen.select("conv_id", "slice", F.lit(0).alias("kind"), none, F.col("state").cast("string").alias("role"), F.col("audit").alias("text"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
        for (conv, part), group in _groups(batches, 2):
            _, _, state, audit = group[0]
            own = [r[2:] for r in group[1:]]
            yield sum(len(r[1]) for r in own), [conv, part, edited(own, audit, int(state))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            chain = (b for bs in ([first], batches) for b in bs)
            yield from _batches(found(chain), [("conv_id", first.schema.field(0).type), ("slice", pa.int64()), ("repaired", pa.list_(ITEM))])

    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, slice bigint, repaired array<struct<edit: string, role: string, text: string>>"
    return _sorted(rows.unionByName(marks), ["conv_id", "slice"], ["kind", "turn", "role", "text"]).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, slice, at (place in the slice), edit, role, text.

    ``turns`` has conv_id, turn, role and text; further columns are left out.  A
    null role or text counts as one space, rows of a null conv_id are one
    conversation.  Turns of one number are ordered by role and text.  Blank turns
    and those with a role and text seen earlier go.  Equal weights: the first
    edits in ASCII order.  Repeated rows are turns of their own; an empty table
    gives an empty one.
    """
    slices = slice_repairs(turns)
    whole = slices.where("not many").select("conv_id", "slice", "repaired")
    both = whole.unionByName(_applied(turns, chosen_paths(slices)))
    return both.select("conv_id", "slice", F.posexplode("repaired").alias("at", "r")).select("conv_id", "slice", "at", "r.*")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """A row per conversation: gaps, counts of faults, cost, audit and the digest of the repaired turns.

    Rules as in ``repaired_turns``.  The digest reads all repaired turns of a
    conversation one after another, which is how it is defined; all else of a cut
    conversation is done by slices.
    """
    line = lambda r: F.concat_ws(":", r["role"], r["text"])
    joined = lambda c: F.array_join(F.transform(F.col(c), line), "\n")
    found = slice_repairs(turns)
    whole = F.when(~F.col("many"), F.sha2(joined("repaired"), 256)).alias("repaired_sha256")
    slices = written(found.select(*[c for c in found.columns if c != "repaired"], whole), "slices")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0).cast("bigint")).alias("gaps")
    columns = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    alone = slices.where("not many").select("conv_id", gaps, *columns)

    chosen = chosen_paths(slices)
    counts = slices.where("many").drop("cost", "audit", "repaired_sha256")
    facts = counts.alias("s").join(chosen.alias("c"), _same("s", "c", "conv_id", "slice")).select("s.*", "c.cost", "c.audit", "c.border")
    parts = lambda value: F.array_sort(F.collect_list(F.struct("slice", value)))
    summed = facts.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "n_turns", "cost")], (F.sum("illegal") + F.sum("border")).alias("illegal"),
        F.min("min_turn").alias("min_turn"), F.max("max_turn").alias("max_turn"),
        F.array_join(parts("audit")["audit"], "").alias("audit"),
    )
    texts = _applied(turns, chosen).where(F.size("repaired") > 0).select("conv_id", "slice", joined("repaired").alias("part"))
    texts = texts.groupBy("conv_id").agg(F.sha2(F.array_join(parts("part")["part"], "\n"), 256).alias("repaired_sha256"))
    cut = summed.alias("s").join(texts.alias("t"), _same("s", "t", "conv_id"), "left").select(
        "s.conv_id", gaps, *[F.col(f"s.{c}") for c in columns[:-1]], F.coalesce("t.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
    return alone.unionByName(cut)
