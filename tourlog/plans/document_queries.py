"""Lines, words and cells of report documents, laid out from the given tables.

Readers of documents store these tables; here they are written once per query
to the shared folder, as the parsers scan them several times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tourlog.operators import documents as D
from tourlog.plans.registry import query, view
from tourlog.session import materialise, spread

SPECS = {"event": ("Event",), "reportNo": ("Report No",), "well": ("Well Name", "Well"), "rig": ("Rig",), "fecha": ("Fecha",)}


def _clock():
    return F.when(F.col("from_time") == "7h30", "07:30").otherwise(F.col("from_time"))


@view("cells")
def cells(i):
    return materialise(i.v("sheet_cells"), "cells")


@view("sheet_cells")
def sheet_cells(i):
    """One sheet per report: labelled fields on top, the operations table below; for a parser that reads cells once."""

    def cell(row, col, value):
        return F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), value.alias("value"))

    c, lit = F.col, F.lit
    top = [
        cell(1, 0, lit("DAILY REPORT")), cell(2, 0, lit("Event:")), cell(2, 1, c("event")), cell(2, 10, lit("Well Name")),
        cell(2, 11, c("wellbore")), cell(3, 0, F.concat(lit("Report No: "), c("report_no"))), cell(4, 0, lit("Rig")), cell(6, 1, c("rig_raw")),
    ]
    names = ["From", "To", "Hrs", "Op Code", "Op Sub", "Op Type", "Operation Details"]
    top += [cell(20, n, lit(name)) for n, name in enumerate(names)]
    heads = i.v("report_base").select(F.col("rk").alias("doc"), F.inline(F.array(*top)))
    values = [_clock(), c("to_time"), c("hours"), c("op_code"), c("op_sub"), c("op_type"), c("operation_details")]
    row = (F.col("row_no") * 2 + 20).cast("int")
    body = [F.struct(row.alias("row"), lit(n).alias("col"), v.alias("value")) for n, v in enumerate(values)]
    more = F.when(c("l_suppkey") % 5 == 0, F.concat(lit("more "), c("l_partkey").cast("string"))).otherwise(lit(""))
    body.append(F.struct((row + 1).alias("row"), lit(6).alias("col"), more.alias("value")))
    rows = i.v("numbered_operations").select(F.col("rk").alias("doc"), F.inline(F.array(*body)))
    return heads.unionByName(rows).withColumn("sheet", F.lit("s"))


@query(
    "grid_fields",
    """
select rk as doc, 'event' as field, event as value, 2 as row, 1 as col from report_base
union all select rk, 'reportNo', report_no, 3, 0 from report_base
union all select rk, 'well', wellbore, 2, 11 from report_base where wellbore <> ''
union all select rk, 'rig', rig_raw, 6, 1 from report_base where rig_raw <> ''
""",
    uses=("report_base",),
)
def grid_fields(i):
    return D.grid_fields(i.v("cells"), SPECS)


@query(
    "missing_grid_fields",
    """
select rk as doc, 'fecha not found' as warning from report_base
union all select rk, 'well not found' from report_base where wellbore = '' union all select rk, 'rig not found' from report_base where rig_raw = ''
""",
    uses=("report_base",),
)
def missing_grid_fields(i):
    docs = i.v("report_base").select(F.col("rk").alias("doc"))
    return D.missing_fields(docs, D.grid_fields(i.v("cells"), SPECS), SPECS).select("doc", "warning")


@query(
    "grid_tables",
    """
select distinct rk as doc, case when from_time = '7h30' then '07:30' else from_time end as "from", to_time as "to", hours, op_code, op_sub, op_type,
  operation_details || case when l_suppkey % 5 = 0 then chr(10) || 'more ' || l_partkey else '' end as operation_details
from operations
""",
    uses=("operations",),
)
def grid_tables(i):
    return D.grid_table(i.v("sheet_cells"), D.GRID_OPERATIONS).drop("sheet", "header_row", "row")


# seven more tables below each other on one sheet: header texts by column; a text over two cells, and a column
# of continued rows that is not the first one, are among them
_GRIDS = {
    "survey_data": ("MD", "Incl", "Azi", "TVD", "VSE", "N/-S", "E/-W", "DLS", "Build"),
    "bit_record": ("Bit No", "Size", "Manufacturer", "Model", "Serial No", "IADC Code", "Nozzles", "MD In", "MD Out", "B-G-O-R"),
    "bit_operating_parameters": (
        "Bit No", "Rot Hrs", "Cum Rot Hrs", "Prog", "Cum Prog", "ROP", "Cum ROP", "WOB", "RPM", "TFA", "P Drop Bit", "Noz Vel", "HHPSI",
    ),
    "mud_products": ("Product", "Units", "Qty", "Used"),
    "bha_components": ("OD", "ID", "Component", "Jts", "Length"),
    "daily_costs": ("Cost Description", "Vendor", "Amount"),
    "bulks": ("Bulks", "Qty Start", "Qty Used", "Qty End"),
}
# columns of the result, in the order of the sheet
_GRID_COLUMNS = {name: [n for n, _ in D.GRID_TABLES[name].headers] for name in _GRIDS} | {"bha_components": ["od", "id", "component", "joints", "length"]}


def _grid_oracle() -> str:
    parts = []
    for t, name in enumerate(_GRIDS):
        for r in range(2):
            values = [f"'{t}-{r}-{c}-' || rk" for c in range(len(_GRID_COLUMNS[name]))]
            if name == "bha_components" and r == 0:
                values[2] += " || chr(10) || 'more ' || rk"
            parts.append(f"select rk as doc, '{name}' as table_name, {100 * t + 12 + 2 * r} as row, " + " || '|' || ".join(values) + " as cells from report_base")
    return " union all ".join(parts)


@query("grid_tables_all", _grid_oracle(), uses=("report_base",))
def grid_tables_all(i):
    """Seven tables of a sheet by their header words."""

    def cell(row, col, value):
        return F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), value.alias("value"))

    rk, found = F.col("rk").cast("string"), []
    for t, (name, heads) in enumerate(_GRIDS.items()):
        top = 100 * t + 10
        found += [cell(top, 0, F.lit(name.replace("_", " ").title()))] + [cell(top + 1, c, F.lit(h)) for c, h in enumerate(heads)]
        for r in range(2):
            found += [cell(top + 2 + 2 * r, c, F.concat(F.lit(f"{t}-{r}-{c}-"), rk)) for c in range(len(_GRID_COLUMNS[name]))]
        if name == "bha_components":
            found.append(cell(top + 3, 2, F.concat(F.lit("more "), rk)))
        found.append(cell(top + 8, 0, F.lit("beyond three blank rows")))
    # one report is more than a hundred cells: reports are shared among the cores before their cells are made
    reports = spread(i.v("report_base").select("rk"))
    cells = reports.select(F.col("rk").alias("doc"), F.lit("s").alias("sheet"), F.inline(F.array(*found)))
    tables = D.grid_tables(cells, {name: D.GRID_TABLES[name] for name in _GRIDS})
    # texts follow the headers of a table, the result the columns of the sheet
    orders = {name: [[n for n, _ in D.GRID_TABLES[name].headers].index(c) for c in columns] for name, columns in _GRID_COLUMNS.items()}
    text = F.coalesce(*[F.when(F.col("table_name") == name, F.concat_ws("|", *[F.get("texts", F.lit(p)) for p in order])) for name, order in orders.items()])
    return tables.select("doc", "table_name", "row", text.alias("cells"))


@query(
    "raw_cells_audit",
    """
select rk as doc, x.address, x.value from report_base, lateral (values ('A1', 'DAILY REPORT'), ('A2', 'Event:'), ('B2', event), ('K2', 'Well Name'), ('L2', wellbore),
  ('A3', 'Report No: ' || report_no), ('A4', 'Rig'), ('B6', rig_raw), ('A20', 'From'), ('B20', 'To'), ('C20', 'Hrs'), ('D20', 'Op Code'), ('E20', 'Op Sub'),
  ('F20', 'Op Type'), ('G20', 'Operation Details')) x(address, value) where x.value <> ''
union all
select rk, y.address, y.value from operations, lateral (values ('A', case when from_time = '7h30' then '07:30' else from_time end), ('B', to_time), ('C', hours),
  ('D', op_code), ('E', op_sub), ('F', op_type), ('G', operation_details), ('+', case when l_suppkey % 5 = 0 then 'more ' || l_partkey else '' end)) z(l, value),
  lateral (select case when l = '+' then 'G' || (row_no * 2 + 21) else l || (row_no * 2 + 20) end as address, z.value as value) y where y.value <> ''
""",
    uses=("report_base", "operations"),
)
def raw_cells_audit(i):
    return D.raw_cells(i.v("sheet_cells")).drop("sheet")


@query(
    "merged_cell_fill",
    """
select rk as doc, x.row, x.col, case when x.row in (4, 5) and x.col in (0, 1) then 'Rig' else x.value end as value
from report_base, lateral (values (1, 0, 'DAILY REPORT'), (2, 0, 'Event:'), (2, 1, event), (2, 10, 'Well Name'), (2, 11, wellbore), (3, 0, 'Report No: ' || report_no),
  (4, 0, 'Rig'), (4, 1, ''), (5, 0, ''), (5, 1, ''), (6, 1, rig_raw), (20, 0, 'From'), (20, 1, 'To'), (20, 2, 'Hrs'), (20, 3, 'Op Code'), (20, 4, 'Op Sub'),
  (20, 5, 'Op Type'), (20, 6, 'Operation Details')) x(row, col, value)
union all
select rk, row_no * 2 + 20 + y.down, y.col, y.value from operations, lateral (values (0, 0, case when from_time = '7h30' then '07:30' else from_time end), (0, 1, to_time),
  (0, 2, hours), (0, 3, op_code), (0, 4, op_sub), (0, 5, op_type), (0, 6, operation_details),
  (1, 6, case when l_suppkey % 5 = 0 then 'more ' || l_partkey else '' end)) y(down, col, value)
""",
    uses=("report_base", "operations"),
)
def merged_cell_fill(i):
    ranges = i.v("report_base").select(
        F.col("rk").alias("doc"), F.lit("s").alias("sheet"), F.lit(4).alias("r1"), F.lit(0).alias("c1"), F.lit(5).alias("r2"), F.lit(1).alias("c2")
    )
    return D.merged_fill(i.v("cells"), ranges).drop("sheet")


# --- lines ---------------------------------------------------------------------------------------------


@view("lines")
def lines(i):
    c, lit = F.col, F.lit
    us_date = F.concat(F.substring("report_date", 6, 2), lit("/"), F.substring("report_date", 9, 2), lit("/"), F.substring("report_date", 1, 4))
    key = c("rk").cast("string")
    texts = [
        lit("DAILY OPERATIONS REPORT"),
        F.concat(lit("  Event: "), c("event"), lit("   Date: "), c("wellbore"), lit(" "), us_date),
        F.concat(lit("Today's MD: 1,"), F.lpad(key, 6, "0"), lit(".5 ft Progress: "), c("report_no"), lit(" ft  Ground Elev: 8")),
        F.concat(lit("AFE Number: "), c("afe_number"), lit("  AFE Cost: 10")),
        F.concat(lit("Current Ops: ahead at "), key),
        lit("second line"),
        F.concat(lit("24-Hr Summary: day "), c("report_no")),
        lit("24-Hr Forecast: go on"),
        lit("CASING/WELL CONTROL"),
        lit("BULKS"),
        F.concat(lit("DIESEL OIL   1,200   "), c("report_no"), lit("  75.5")),
        F.concat(lit("Incident Comments: none at "), c("event")),
        lit("page 1 of 2"),
        lit("checked"),
        lit("Other Remarks: x"),
    ]
    heads = i.v("report_base").select(c("rk").alias("doc"), F.posexplode(F.array(*texts)).alias("line_no", "line"))
    kind = F.when(c("op_type") == "SC", "SC").otherwise(c("op_type"))
    opening = F.concat_ws(" ", _clock(), c("to_time"), (c("l_quantity") / 4).cast("string"), c("op_code"), kind, lit("detail"), c("l_partkey").cast("string"))
    row = c("row_no") * 2 + 20
    more = F.when(c("l_suppkey") % 5 == 0, F.concat(lit("cont "), c("l_partkey").cast("string"))).otherwise(lit(" "))
    both = F.array(F.struct(row.alias("line_no"), opening.alias("line")), F.struct((row + 1).alias("line_no"), more.alias("line")))
    ops = i.v("numbered_operations").select(c("rk").alias("doc"), F.inline(both))
    tail = i.v("report_base").select(c("rk").alias("doc"), lit(90000).alias("line_no"), lit("Safety Incident? N").alias("line"))
    return materialise(heads.unionByName(ops).unionByName(tail).withColumn("page", F.lit(1)), "lines")


@query(
    "labelled_fields",
    """
select rk as doc, '1' || lpad(rk::varchar, 6, '0') || '.5' as "todayMd", report_no as progress, afe_number as "afeNumber", '' as "prevMd", '' as "rotHrsToday",
  '' as "lastCasing", '' as "nextCasing", '' as "pumpRate", '' as "pumpPress" from report_base
""",
    uses=("report_base",),
)
def labelled_fields(i):
    return D.labelled_fields(i.v("lines"), D.DRILLING_FIELDS)


@query(
    "header_line",
    """select rk as doc, event, wellbore, report_date as "reportDate" from report_base""",
    uses=("report_base",),
)
def header_line(i):
    return D.header_line(i.v("lines"))


@query(
    "text_blocks",
    """
select rk as doc, 'currentOps' as block, 0 as part, 'ahead at ' || rk || chr(10) || 'second line' as text from report_base
union all select rk, 'summary24h', 0, 'day ' || report_no from report_base union all select rk, 'forecast24h', 0, 'go on' from report_base
""",
    uses=("report_base",),
)
def text_blocks(i):
    blocks = {
        "currentOps": ("Current Ops:", ("24-Hr Summary:",)), "summary24h": ("24-Hr Summary:", ("24-Hr Forecast:",)),
        "forecast24h": ("24-Hr Forecast:", ("CASING/WELL CONTROL",)),
    }
    return D.text_blocks(i.v("lines"), blocks)


@query(
    "section_slice",
    "select rk as doc, 2 as n, 10 as first_line from report_base",
    uses=("report_base",),
)
def section_slice(i):
    rows = D.section_slice(i.v("lines"), "24-Hr Forecast:", ("BULKS",))
    shifted = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("_l"))
    return shifted.select("doc", "n", (F.col("_l") + 2).alias("first_line"))


@query(
    "line_tables",
    """
select rk as doc, 'DIESEL OIL' as bulk, '1200' as qty_start, '75.5' as qty_used, report_no as qty_end from report_base
""",
    uses=("report_base",),
)
def line_tables(i):
    return D.bulk_rows(i.v("lines")).select("doc", "bulk", "qty_start", "qty_used", "qty_end")


@query(
    "incident_block",
    "select rk as doc, 1 as page, 0 as part, 'none at ' || event || chr(10) || 'checked' as text from report_base",
    uses=("report_base",),
)
def incident_block(i):
    return D.incident_block(i.v("lines"))


@query(
    "text_operation_rows",
    """
select rk as doc, row_no * 2 + 20 as start_line, 0 as part, case when from_time = '7h30' then '07:30' else from_time end as "from", to_time as "to",
  (l_quantity / 4)::varchar as hours, case when op_type in ('P', 'NPT') then op_type else '' end as op_type,
  case when op_type in ('P', 'NPT') then op_code when op_type = '' then op_code || '  detail ' || l_partkey else op_code || ' ' || op_type || ' detail ' || l_partkey end as head,
  trim(case when op_type in ('P', 'NPT') then 'detail ' || l_partkey else '' end || case when l_suppkey % 5 = 0 then chr(10) || 'cont ' || l_partkey else '' end, chr(10)) as text
from operations
""".replace("op_code || '  detail '", "op_code || ' detail '"),
    uses=("operations",),
)
def text_operation_rows(i):
    return D.text_operation_rows(i.v("lines")).drop("page")


@view("words")
def words(i):
    c, lit = F.col, F.lit

    def word(text, x0, top):
        return F.struct(text.alias("text"), lit(float(x0)).alias("x0"), lit(x0 + 8.0).alias("x1"), top.cast("double").alias("top"))

    head = [word(lit(t), x, lit(y)) for t, x, y in (("From", 20, 100), ("To", 55, 101), ("Code", 110, 100), ("Details", 360, 102), ("Safety", 20, 1900))]
    heads = i.v("report_base").select(c("rk").alias("doc"), F.inline(F.array(*head)))
    top = c("row_no") * 30 + 120
    row = [
        word(_clock(), 22, top), word(c("to_time"), 55, top + 1), word((c("l_quantity") / 4).cast("string"), 90, top), word(c("op_code"), 110, top),
        word(lit("P"), 190, top), word(lit("lot"), 215, top - 1),
        word(c("l_partkey").cast("string"), 240, top), word(lit("more"), 215, top + 10), word(c("l_suppkey").cast("string"), 250, top + 10),
    ]
    rows = i.v("numbered_operations").select(c("rk").alias("doc"), F.inline(F.array(*row)))
    return materialise(heads.unionByName(rows).withColumn("page", lit(1)).withColumn("page_height", lit(2000.0)), "words")


@query(
    "positional_rows",
    """
select rk as doc, case when from_time = '7h30' then '07:30' else from_time end as "from", to_time as "to", (l_quantity / 4)::varchar as hours, op_code,
  '' as op_sub, 'P' as op_type, 'lot ' || l_partkey || chr(10) || 'more ' || l_suppkey as operation_details
from operations
""",
    uses=("operations",),
)
def positional_rows(i):
    return D.positional_rows(i.v("words"), D.DRILLING_WORDS).drop("page", "row")


@query(
    "distinct_rows",
    "select count(*) as n from (select distinct rk, from_time, to_time, hours, op_code, op_sub, op_type, operation_details from operation_base)",
    uses=("operation_base",),
)
def distinct_rows(i):
    """Repeated rows of one document reduce to the first, whatever their place."""
    names = ["from_time", "to_time", "hours", "op_code", "op_sub", "op_type", "operation_details"]
    rows = i.v("operation_base").select(F.col("rk").alias("doc"), "l_linenumber", "l_partkey", *names)
    return D.dedupe_rows(rows, names).agg(F.count(F.lit(1)).alias("n"))


# --- the given documents and pages as lines ------------------------------------------------------------------


@query(
    "document_lines",
    "select doc_id as doc, count(*) as n_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where trim(line, ' ' || chr(9) || chr(13)) <> '' group by doc_id",
)
def document_lines(i):
    rows = i.t("documents").select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("line"))
    return rows.filter(F.trim("line", F.lit(" \t\r")) != "").groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"))
