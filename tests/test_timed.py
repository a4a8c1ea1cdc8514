"""Events in any order over several triggers: results plus late rows equal the batch result."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tourlog.streaming import timed as TD

EVENTS = "event_id bigint, record_id string, time timestamp, event_type string, cents bigint"
START = datetime(2024, 1, 1)


def events(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        drift = timedelta(hours=k * 3 + rng.choice([0, 0, 0, -30, -200]))
        rows.append((k, f"J{rng.randrange(30)}", START + drift + timedelta(days=20), rng.choice("abc"), rng.randrange(100)))
    return rows + [rows[5], rows[100], (999, "J1", None, "a", 1)]


def feed(spark, folder, batches, take):
    """Write a file, run; two files, run: the second run takes two triggers."""
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/p{n}")
        if n != 1:
            take(source.parquet(str(folder)))


def parts(rows, n, seed):
    rows = list(rows)
    if seed:
        random.Random(seed).shuffle(rows)
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]


@pytest.mark.parametrize("order", [0, 1])
def test_usage_and_late_rows(spark, tmp_path, order):
    rows = events(3)
    batches = parts(rows, 4, order)
    run = TD.TimedRun(spark, str(tmp_path / "run"), timedelta(days=2))
    feed(spark, tmp_path / "in", batches, lambda s: TD.count_usage(s, run, compact_after=2))
    late = [tuple(r)[:5] for r in run.read("late", EVENTS).select("event_id", "record_id", "time", "event_type", "cents").collect()]
    # the plain loop
    newest, accepted, want_late = None, {}, []
    for batch in batches:
        mark = newest and newest - timedelta(days=2)
        for r in batch:
            if r[2] is None or (mark and r[2] < mark):
                want_late.append(r)
            else:
                accepted.setdefault(r[0], r)
        newest = max([t for t in [newest, *(r[2] for r in batch)] if t])
    assert sorted(map(repr, late)) == sorted(map(repr, want_late))
    want = Counter()
    for r in accepted.values():
        want[f"{r[2]:%Y-%m-%d}", r[3], "n"] += 1
        want[f"{r[2]:%Y-%m-%d}", r[3], "cents"] += r[4]
    got = {(r.day, r.event_type, c): r[c] for r in TD.usage(run).collect() for c in ("n", "cents")}
    assert got == dict(want)
    # nothing is lost: accepted and late events together are all events
    assert set(accepted) | {r[0] for r in late} == {r[0] for r in rows} and (order or len(accepted) > 100)


@pytest.mark.parametrize("order", [0, 2])
def test_states_expire_and_come_back(spark, tmp_path, order):
    rows = events(7)
    run = TD.TimedRun(spark, str(tmp_path / "run"), timedelta(days=3))
    log = TD.state_log(spark, run.root, "event_id bigint, event_type string", buckets=4)
    feed(spark, tmp_path / "in", parts(rows, 4, order), lambda s: TD.keep_states(s, run, log, timedelta(days=4), compact_after=2))
    late = [(r.record_id, r.time, r.event_id, r.event_type) for r in run.read("late", EVENTS).collect()]
    best = {}
    for r in TD.all_states(log).collect():
        best[r.record_id] = max(best.get(r.record_id, (datetime.min,)), tuple(r)[1:])
    for job, *rest in late:
        if rest[0]:
            best[job] = max(best.get(job, (datetime.min,)), tuple(rest))
    want = {}
    for event, job, time, kind, _ in rows:
        if time:
            want[job] = max(want.get(job, (datetime.min,)), (time, event, kind))
    assert best == want
    held = log.state("states").collect()
    if order == 0:  # silent jobs have left the state
        assert 0 < log.archive("states").count() and len(held) < len(want)
    assert len({r.record_id for r in held}) == len(held)
