"""Tables in cell grids against a plain walk over the rows of a sheet."""

import random
import re

from tourlog.operators import documents as D

CELLS = "doc int, sheet string, row int, col int, value string"


def norm(text):
    return re.sub(r"[^a-z0-9%/+.-]+", " ", text.lower()).strip()


def squeeze(text):
    return re.sub(r"\s+", " ", text).strip()


def tidy(text):
    return re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", text)).strip()


def plain_columns(row, spec):
    line = norm(" ".join(row[c] for c in sorted(row)))
    found, used = [], set()
    for name, aliases in spec.headers:
        col = next((c for c in sorted(row) if norm(row[c]) and any(a in norm(row[c]) for a in aliases)), None)
        if col is None and any(a in line for a in aliases):
            col = found[-1][0] + 1 if found else 0
        if col is not None and col not in used:
            used.add(col)
            found.append((col, name))
    return sorted(found) if len(found) >= spec.min_hits else None


def plain_table(sheet, spec):
    """Rows of one sheet {row: {col: text}}."""
    words = " ".join(a for _, aliases in spec.headers for a in aliases)
    out = []
    for head in sorted(sheet):
        columns = plain_columns(sheet[head], spec)
        blanks, rows = 0, []
        for r in range(head + 1, max(sheet) + 1) if columns else ():
            row = sheet.get(r, {})
            line = norm(" ".join(row[c] for c in sorted(row)))
            if any(m in line for m in spec.stops):
                break
            if not line:
                blanks += 1
                if blanks == 3:
                    break
                continue
            blanks = 0
            if line in D.SECTION_TITLES and line not in words:
                break
            parsed = {}
            for k, (col, name) in enumerate(columns):
                end = columns[k + 1][0] if k + 1 < len(columns) else 10**6
                values = [row[c] for c in sorted(row) if col <= c < end]
                parsed[name] = tidy("\n".join(values)) if name == "operation_details" else squeeze(" ".join(values))
            if not any(parsed.values()):
                continue
            first = parsed[columns[0][1]]
            rest = [v for n, v in parsed.items() if n != spec.continuation]
            more = spec.continuation and not first and not any(rest)
            if spec.first_pattern and not re.search(spec.first_pattern, first) or rows and more:
                if rows and spec.continuation:
                    text = " ".join(v for v in parsed.values() if v)
                    rows[-1][spec.continuation] = tidy(rows[-1].get(spec.continuation, "") + "\n" + text)
                continue
            rows.append(parsed)
        out += rows
    names = [n for n, _ in spec.headers]
    return {tuple(r.get(n, "") for n in names) for r in out}


def test_tables_equal_the_walk(spark):
    rng = random.Random(5)
    specs = {"operations": D.GRID_OPERATIONS, "bha_components": D.GRID_TABLES["bha_components"], "mud_products": D.GRID_TABLES["mud_products"]}
    heads = {
        "operations": ["From", "To", "Hrs", "Op Code", "Op Sub", "Op Type", "Operation Details"],
        "bha_components": ["OD", "ID", "Component", "Jts", "Length"], "mud_products": ["Product", "Units", "Qty", "Used"],
    }
    sheets = {}
    for doc in range(70):
        row, sheet = 1, {}
        for _ in range(rng.randrange(1, 4)):
            name = rng.choice(list(heads))
            sheet[row] = {2 * c if rng.random() < 0.5 or name != "operations" else 2 * c: h for c, h in enumerate(heads[name])}
            for _ in range(rng.randrange(0, 9)):
                row += rng.choice([1, 1, 1, 2, 4])
                kind = rng.random()
                if kind < 0.55:
                    sheet[row] = {2 * c: rng.choice(["06:00", "7", "", "x  y"]) if c == 0 else rng.choice(["a", "b\nc", "", "日本"]) for c in range(len(heads[name]))}
                elif kind < 0.8:
                    sheet[row] = {rng.choice([4, 12, 13]): rng.choice(["more", "two\nlines"])}
                elif kind < 0.9:
                    sheet[row] = {0: rng.choice(["***", "Bulks", "Mud Data", "Other Remarks: none", "Fluid Losses"])}
                sheet[row] = {c: v for c, v in sheet.get(row, {}).items() if v}
            row += rng.choice([1, 2, 5])
        sheets[doc] = {r: cells for r, cells in sheet.items() if cells}
    cells = spark.createDataFrame([(d, "s", r, c, v) for d, s in sheets.items() for r, row in s.items() for c, v in row.items()], CELLS)
    for name, spec in specs.items():
        got = {}
        for r in D.grid_table(cells, spec).collect():
            got.setdefault(r.doc, set()).add(tuple(r[n] for n, _ in spec.headers))
        assert got == {d: rows for d, s in sheets.items() if s and (rows := plain_table(s, spec))}, name


def test_labels_are_broadcast_and_not_the_words_of_cells(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(D, "materialise", lambda df, purpose: seen.append(df) or df)
    cells = spark.createDataFrame([(1, "s", 2, 0, "Event:"), (1, "s", 2, 1, "drill")], "doc int, sheet string, row int, col int, value string")
    assert [r.value for r in D.grid_fields(cells, {"event": ("Event",)}).collect()] == ["drill"]
    assert "rightHint=(strategy=broadcast)" in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_tables_are_read_in_one_walk_that_moves_cells_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(D, "materialise", lambda df, purpose: written.append(purpose) or df)
    rows = {1: ["Product", "Units", "Qty", "Used"], 2: ["gel", "sx", "4", "1"], 3: ["Bulks", "Qty Start", "Qty Used", "Qty End"], 4: ["fuel", "9", "2", "7"], 5: ["Product", "Units", "Qty Used"], 6: ["Séal", "x", "1"]}
    cells = spark.createDataFrame([(1, "s", r, c, v) for r, row in rows.items() for c, v in enumerate(row)], CELLS)
    found = D.grid_tables(cells, {n: D.GRID_TABLES[n] for n in ("mud_products", "bulks")})
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = {(r.table_name, r.header_row, r.row, *r.texts) for r in found.collect()}
    # no stop between the headers: each table goes on below the next header, in its own columns
    assert {("mud_products", 1, 2, "gel", "sx", "4 1"), ("bulks", 3, 4, "fuel", "9", "2", "7"), ("mud_products", 1, 6, "Séal", "x", "1")} <= got
    assert not written and plan.count("Exchange hashpartitioning") == 1
