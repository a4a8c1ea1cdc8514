"""Findings of round 4: odd inputs and larger tables."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


def folder_with(tmp_path, name, table):
    """The smallest tables, one of them another."""
    for f in os.listdir(SF):
        if f != f"{name}.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    pq.write_table(table, tmp_path / f"{name}.parquet")
    return str(tmp_path)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_memory_of_odd_texts(spark, tmp_path):
    """texts without words, other white space at their ends, no text, source or id at all."""
    texts = [None, "", " ", "\xa0", "　x\x0b", "x", " x\t", "x src1", "\x0c", None, "y", "y "]
    rows = [(i if i != 10 else None, t, lang, source) for i, (t, lang, source) in enumerate((t, lang, s) for t in texts for lang in ("es", "en") for s in ("src0", "src1", None))]
    rows += [(None, "only without id", "es", "src0"), (None, "only without id", "en", "src0")]
    cols = list(zip(*rows))
    docs = pa.table({"doc_id": pa.array(cols[0], pa.int64()), "text": pa.array(cols[1], pa.string()), "lang": list(cols[2]), "source": list(cols[3]), "n_chars": pa.array([1] * len(rows), pa.int64())})
    d = folder_with(tmp_path, "documents", docs)
    status, detail, _, _ = compare(spark, connect(d), d, "save_memory", entry.queries()["save_memory"], entry.oracle_sql()["save_memory"])
    assert status == "ok", detail


def test_stage_near_keeps_no_sets_on_disk(spark, tmp_path, monkeypatch):
    """cells and sets take several times the disk of their texts; shuffle files end with the table they made."""
    import random

    from tourlog.llm import jaccard, storage

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [rng.choices(words, k=300) for _ in range(60)]
    texts += [[*t[:290], *rng.choices(words, k=10)] for t in texts]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(storage, "shared_folder", lambda session, purpose: str(tmp_path / f"{purpose}-{len(os.listdir(tmp_path))}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == list(range(60))
    disk = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    assert disk < 1.3 * sum(len(t) for _, t in rows)
    before, own = spark.conf.get(storage.CLEANUP, None), []
    with storage.shuffles_end(spark):
        own.append(spark.conf.get(storage.CLEANUP))
    assert own == ["true"] and spark.conf.get(storage.CLEANUP, None) == before


def test_mix_moves_no_text_to_number_it(spark):
    """places in the mix are found without texts, which meet them in one join."""
    from tourlog.llm import mixing

    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs, mixing.tempered_weights(docs, alpha=0.9))
    assert mixed.select("doc_id").distinct().count() == 200 and mixed.where("mix_slot is null").count() == 0
    windows = [x for x in mixed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in x]
    below = mixed._jdf.queryExecution().optimizedPlan().toString().split(windows[-1])[1].split("\n")[1]
    assert "text#" not in below


def test_fields_of_a_sheet(spark):
    """F2 F3 F5: labels are found by their first and last words, without a pattern of all labels for every cell; values on the right come first."""
    from tourlog.operators import documents as D

    specs = {"Today's MD": ("Today's MD", "MD"), "depth": ("MD",), "rig": ("Rig",), "crew": ("Crew Chief",)}
    values = [
        (1, 0, "MD"), (1, 7, "8"), (2, 0, "77"), (4, 0, "The Rig"), (4, 1, "Crew Chief"), (5, 2, "x"), (6, 2, "Ann"), (6, 0, "R 1"),
        (9, 0, "Rig: too late"), (9, 1, "crew chief: rig"), (9, 5, "Bob"),
    ]
    cells = spark.createDataFrame([("d", "s", r, c, v) for r, c, v in values], "doc string, sheet string, row int, col int, value string")
    found = D.grid_fields(cells, specs)
    assert "(?:^| )(?:" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.field: (r.value, r.row, r.col) for r in found.collect()}
    assert got == {"Today's MD": ("8", 1, 7), "depth": ("8", 1, 7), "rig": ("R 1", 6, 0), "crew": ("Ann", 6, 2)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_reports_are_shared_before_their_cells_are_made(spark):
    """a small file of reports is one task, and would make all cells in it."""
    from tourlog.plans.registry import QUERIES, Inputs

    plan = QUERIES["grid_tables_all"](Inputs(spark, SF))._jdf.queryExecution().executedPlan().toString()
    made = plan.rindex("Generate inline")
    assert "RoundRobinPartitioning" in plan[made:]
