"""Tables of lines, positioned words and cells turned into fields and rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tourlog.functions import scalars as S
from tourlog.functions import text as X
from tourlog.operators import ordering
from tourlog.session import materialise

NUM = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"


@dataclass(frozen=True)
class LineField:
    """Value between a label and the next one on the first line with the label."""

    field: str
    label: str
    stop: str = ""
    number: bool = False


# fixed values: labelled fields of the English drilling layout
DRILLING_FIELDS = (
    LineField("todayMd", "Today's MD:", "Progress:", True),
    LineField("progress", "Progress:", "Ground Elev:", True),
    LineField("prevMd", "Prev MD:", "Rot Hrs Today", True),
    LineField("rotHrsToday", "Rot Hrs Today", "AFE MD/Days:", True),
    LineField("afeNumber", "AFE Number:", "AFE Cost:"),
    LineField("lastCasing", "Last Casing:", "Str Wt Up/Dn:"),
    LineField("nextCasing", "Next Casing:", "Str Wt Rot:"),
    LineField("pumpRate", "Pump Rate:", "Conn:", True),
    LineField("pumpPress", "Pump Press:", "Trip:", True),
)


def first_lines(lines: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Per document the first line that holds each label: one aggregate for all labels."""
    place = F.struct("page", "line_no")
    return lines.groupBy("doc").agg(
        *[F.min_by("line", F.when(F.contains("line", F.lit(label)), place)).alias(name) for name, label in labels.items()]
    )


def labelled_fields(lines: DataFrame, specs: tuple[LineField, ...]) -> DataFrame:
    """One row per document with a column per field, '' where the label is absent."""
    found = first_lines(lines, {s.field: s.label for s in specs})

    def value(s: LineField) -> Column:
        raw = S.value_between(S.text(F.col(s.field)), s.label, s.stop)
        return S.first_number(raw) if s.number else raw

    return found.select("doc", *[value(s).alias(s.field) for s in specs])


def header_line(lines: DataFrame) -> DataFrame:
    """Event, well and date of the headline of the drilling layout."""
    found = first_lines(lines, {"_line": "Event:"})
    pattern = r"Event:\s*(.*?)\s+Date:\s*([A-Z0-9-]+)?\s*([0-9]{2}/[0-9]{2}/[0-9]{4})"
    part = lambda n: S.squeeze(F.regexp_extract(S.text(F.col("_line")), pattern, n))
    return found.select(
        "doc", part(1).alias("event"), part(2).alias("wellbore"), S.date_from_slashes(part(3), day_first=False).alias("reportDate")
    )


def any_marker(c: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers], F.lit(False))


def section_slice(lines: DataFrame, start: str, stops: tuple[str, ...], keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Lines from the first start marker up to the next stop marker.

    The two bounds are minima per document, so no document is sorted.
    """
    key = list(keys)
    place = F.struct("page", "line_no")
    begins = lines.filter(F.contains("line", F.lit(start))).groupBy(*key).agg(F.min(place).alias("_from"))
    after = lines.join(begins, key).filter(place >= F.col("_from"))
    ends = after.filter((place > F.col("_from")) & any_marker(F.col("line"), stops)).groupBy(*key).agg(F.min(place).alias("_to"))
    return after.join(ends, key, "left").filter(F.col("_to").isNull() | (place < F.col("_to"))).drop("_from", "_to")


PART_LINES = 256


def joined_parts(lines: DataFrame, keys: list[str], number: Column, text: str = "line") -> DataFrame:
    """Lines joined by newline in parts of bounded size, in ``part`` order."""
    place = F.struct("page", "line_no")
    rows = lines.withColumn("part", F.floor(number / PART_LINES).cast("int"))
    grouped = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct(place.alias("_p"), F.col(text).alias("t")))).alias("_l"))
    return grouped.select(*keys, "part", X.multiline(F.array_join(F.col("_l.t"), "\n")).alias("text"))


def block_lines(lines: DataFrame, start: str, stops: tuple[str, ...], keys: tuple[str, ...] = ("doc",)) -> DataFrame:
    """Lines of the text between the first start label and the next stop label.

    Both are cut by the place of the label in its line, so text after the start
    label and before the stop label stays, and a block may begin and end on one
    line.
    """
    key = list(keys)
    place = F.struct("page", "line_no")
    begins = lines.filter(F.contains("line", F.lit(start))).groupBy(*key).agg(F.min(place).alias("_from"))
    tail = F.substr("line", F.locate(start, F.col("line")) + len(start))
    after = lines.join(begins, key).filter(place >= F.col("_from")).withColumn("line", F.when(place == F.col("_from"), tail).otherwise(F.col("line")))
    ends = after.filter(any_marker(F.col("line"), stops)).groupBy(*key).agg(F.min(place).alias("_to"))
    rows = after.join(ends, key, "left").filter(F.col("_to").isNull() | (place <= F.col("_to")))
    head = F.regexp_extract("line", "(?s)^(.*?)(?:" + "|".join(re.escape(m) for m in stops) + ")", 1)
    return rows.withColumn("line", F.when(place == F.col("_to"), head).otherwise(F.col("line"))).drop("_from", "_to")


def block_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each block; one longer than PART_LINES lines comes in parts counted from its first line."""
    sliced = rows.withColumn("_slice", F.floor(F.col("line_no") / PART_LINES))
    numbered = ordering.number_rows(sliced, keys, ["page", "_slice"] if "page" not in keys else ["_slice"], ["page", "line_no"], "_no")
    return joined_parts(numbered, keys, F.col("_no") - 1)


def text_blocks(lines: DataFrame, blocks: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(doc, block, part, text) for each named block: start label and stop labels."""
    rows = [block_lines(lines, start, stops).withColumn("block", F.lit(name)) for name, (start, stops) in blocks.items()]
    return block_parts(reduce(DataFrame.unionByName, rows), ["doc", "block"]).filter("text <> ''").select("doc", "part", "text", "block")


def pages_with(lines: DataFrame, marker: str) -> DataFrame:
    """Lines of the pages that show a section heading."""
    pages = lines.filter(F.contains("line", F.lit(marker))).select("doc", "page").distinct()
    return lines.join(pages, ["doc", "page"], "left_semi")


def pattern_rows(lines: DataFrame, pattern: str, groups: dict[str, int], numbers: tuple[str, ...] = ()) -> DataFrame:
    """One row per line that matches, a column per capturing group."""
    hit = lines.filter(F.col("line").rlike(pattern))
    cells = {n: S.squeeze(F.regexp_extract("line", pattern, g)) for n, g in groups.items()}
    return hit.select(
        "doc", "page", "line_no", *[(F.translate(c, ",", "") if n in numbers else c).alias(n) for n, c in cells.items()]
    )


# fixed values: row patterns of the line layouts
SURVEY_ROW = (
    r"([0-9]{1,2},[0-9]{3}\.[0-9])\s+([0-9]{1,3}\.[0-9]{2})\s+([0-9]{1,2},[0-9]{3}\.[0-9]{2})\s+([0-9]{1,2},[0-9]{3}\.[0-9])"
    r"([0-9]{1,3}\.[0-9]{2})\s+([0-9]{1,2},[0-9]{3}\.[0-9])\s+([0-9]{1,2},[0-9]{3}\.[0-9])\s+(-?[0-9]+\.[0-9]{2})\s+(-?[0-9]+\.[0-9]{2})"
)
BULK_ROW = rf"^\s*([A-Z][A-Z0-9 /-]+?)\s+({NUM})\s+({NUM})\s+({NUM})"
BHA_ROW = rf"([A-Za-z][A-Za-z0-9 /\\-]+?)\s+([0-9]+\.[0-9]{{3}})\s+([0-9]+\.[0-9]{{3}})\s+([0-9]+)\s+({NUM})"
INTERVAL_ROW = (
    rf"^\s*([A-ZÁÉÍÓÚÑ0-9 ]+?)\s+({NUM})\s+({NUM})\s+({NUM})\s+({NUM})\s+(.+?)\s+({NUM})\s+({NUM})\s+({NUM})"
    r"\s+([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\s+([A-Z]+)(?:\s+(.*))?$"
)
TIME_ROW = r"^\s*([0-9]{1,2}:[0-9]{2})\s+([0-9]{1,2}:[0-9]{2})\s+([0-9]+(?:\.[0-9]+)?)\s+(.*)$"
OPERATION_STOPS = ("Safety Incident?", "Environ Incident?", "Other Remarks:", "Page ", "DAILY OPERATIONS REPORT")


def survey_rows(lines: DataFrame) -> DataFrame:
    names = {"md": 1, "incl": 2, "tvd": 3, "vse": 4, "azi": 5, "ns": 6, "dls": 8, "build": 9}
    rows = pattern_rows(lines, SURVEY_ROW, names, ("md", "tvd", "vse", "ns"))
    return ordering.top_rows(rows, ["doc"], [F.col("page"), F.col("line_no")], 6, "row_no")


def bulk_rows(lines: DataFrame, layout: str = "drilling") -> DataFrame:
    """Bulk stock rows; the layouts differ in the order of used and end."""
    used, end = (4, 3) if layout == "drilling" else (3, 4)
    marker = "BULKS" if layout == "drilling" else "Combustible"
    names = {"bulk": 1, "qty_start": 2, "qty_used": used, "qty_end": end}
    rows = pattern_rows(pages_with(lines, marker), BULK_ROW, names, ("qty_start", "qty_used", "qty_end"))
    return rows.filter(F.col("bulk") != marker)


def bha_rows(lines: DataFrame, offset: int = 95) -> DataFrame:
    """String components, read right of a fixed print column."""
    right = lines.withColumn("line", F.substring("line", offset + 1, 100000))
    rows = pattern_rows(right, BHA_ROW, {"component": 1, "od": 2, "id": 3, "joints": 4, "length": 5}, ("length",))
    return rows.filter(F.lower("component") != "component")


def interval_rows(lines: DataFrame, day_first: bool) -> DataFrame:
    names = ("formation", "top_md", "base_md", "length", "density", "charges", "phase", "penetration", "diameter", "date", "status", "comments")
    numbers = ("top_md", "base_md", "length", "density", "phase", "penetration", "diameter")
    rows = pattern_rows(pages_with(lines, "INTERVALOS CAÑONEADOS"), INTERVAL_ROW, {n: i + 1 for i, n in enumerate(names)}, numbers)
    return rows.withColumn("date", S.date_from_slashes(F.col("date"), day_first))


# more lines than any page has
PAGE_LINES = 1 << 24


def text_operation_rows(lines: DataFrame) -> DataFrame:
    """Operation rows of plain text: a clock line opens a row, later lines continue it, over page ends too.

    Returns (doc, page, start_line, part, from, to, hours, op_type, head, text) with
    the place of the opening line; line numbers may begin anew on each page.  Long
    rows come in several parts.
    """
    placed = lines.withColumn("_place", F.col("page").cast("bigint") * PAGE_LINES + F.col("line_no"))
    starts = F.when(F.col("line").rlike(TIME_ROW), F.col("_place"))
    rows = ordering.carry_forward(placed, ["doc"], "_place", starts, "_start").filter("_start is not null")
    opening = F.col("_place") == F.col("_start")
    kept = rows.filter(opening | ~(S.blank(F.col("line")) | any_marker(F.col("line"), OPERATION_STOPS)))
    rest = F.regexp_extract("line", TIME_ROW, 4)
    kind = F.when(rest.rlike(r"\bNPT\b"), "NPT").when(rest.rlike(r"\bP\b"), "P").otherwise("")
    staged = kept.withColumn("_rest", F.when(opening, rest)).withColumn("op_type", F.when(opening, kind))
    cut = F.when(F.col("op_type") == "NPT", F.split("_rest", r"\bNPT\b", 2)).when(F.col("op_type") == "P", F.split("_rest", r"\bP\b", 2))
    staged = staged.withColumn("head", S.squeeze(F.coalesce(F.get(cut, F.lit(0)), F.col("_rest"))))
    tail = F.coalesce(S.squeeze(F.get(cut, F.lit(1))), F.lit(""))
    body = staged.withColumn("line", F.when(opening, tail).otherwise(F.col("line")))
    text = block_parts(body, ["doc", "_start"])
    heads = staged.filter(opening).select(
        "doc", "_start", "page", F.col("line_no").alias("start_line"),
        *[F.regexp_extract("line", TIME_ROW, i + 1).alias(n) for i, n in enumerate(("from", "to", "hours"))], "op_type", "head",
    )
    return heads.join(text, ["doc", "_start"]).drop("_start")


def incident_block(lines: DataFrame, label: str = "Incident Comments:", stops: tuple[str, ...] = ("Other Remarks:", "OpenWells")) -> DataFrame:
    """Comment block bounded by its page, without page furniture."""
    from tourlog.functions import dims

    rows = block_lines(lines, label, stops, ("doc", "page"))
    furniture = f"(?i)^\\s*(?:{'|'.join(dims.PAGE_FURNITURE)})\\s*$"
    return block_parts(rows.filter(~F.col("line").rlike(furniture) & ~S.blank(F.col("line"))), ["doc", "page"])


# --- positioned words -----------------------------------------------------------------------------


@dataclass(frozen=True)
class WordLayout:
    """Print positions of an operations table (points from the left edge)."""

    header: dict
    edges: tuple[float, ...]
    starts: tuple[float, ...]
    gap: float
    tolerance: float
    stops: tuple[str, ...]
    stop_gap: float
    stop_x: float
    # words that begin so end the table as well, left of prefix_x
    stop_prefixes: tuple[str, ...] = ()
    prefix_x: float = 0.0
    # two words side by side, in any case, that end the table wherever they are
    stop_pair: tuple[str, ...] = ()
    # the table ends so far above the stop word
    lift: float = 0.0


# fixed values: print positions of the drilling layout
DRILLING_WORDS = WordLayout(
    header={"From": (15, 55), "To": (45, 80), "Code": (95, 140), "Details": (350, 430)},
    edges=(20, 52, 82, 106, 133, 185, 210, 585),
    starts=(20, 50, 50, 82, 84, 110),
    gap=10, tolerance=2.5,
    stops=("Safety", "Environ", "Incident", "Other", "Remarks:", "POB:"), stop_gap=20, stop_x=120,
    stop_pair=("incident", "comments"),
)
COLUMNS = ("from", "to", "hours", "op_code", "op_sub", "op_type", "operation_details")


def _between(c: str, low: float, high: float) -> Column:
    return (F.col(c) >= low) & (F.col(c) <= high)


def _table_span(words: DataFrame, layout: WordLayout) -> DataFrame:
    """(doc, page, _h, _end): top of the header and end of the operations table of each page that has one."""
    names = list(layout.header)
    top, text = F.col("top"), F.col("text")
    listed = {f"_p{n}": F.when((text == name) & _between("x0", *layout.header[name]), top) for n, name in enumerate(names)}
    ends = text.isin(*layout.stops) & (F.col("x0") < layout.stop_x)
    for prefix in layout.stop_prefixes:
        ends = ends | (F.startswith(text, F.lit(prefix)) & (F.col("x0") < layout.prefix_x))
    listed["_stops"] = F.when(ends, top)
    if layout.stop_pair:
        one, two = layout.stop_pair
        listed["_left"] = F.when(F.lower(text) == one, F.struct(F.col("x1").alias("x"), top))
        listed["_right"] = F.when(F.rtrim(F.lower(text), F.lit(":")) == two, F.struct(F.col("x0").alias("x"), top))
    pages = words.groupBy("doc", "page").agg(F.max("page_height").alias("_height"), *[F.collect_set(c).alias(n) for n, c in listed.items()])
    near = lambda h, n: F.exists(f"_p{n}", lambda p: (p >= h - 2) & (p <= h + 16))
    whole = lambda h: reduce(lambda p, q: p & q, [near(h, n) for n in range(1, len(names))], F.lit(True))
    found = pages.filter("size(_p0) > 0").withColumn("_h", F.array_min(F.filter("_p0", whole))).filter("_h is not null")
    stops = F.col("_stops")
    if layout.stop_pair:
        beside = lambda a, b: (b["x"] - a["x"] >= 0) & (b["x"] - a["x"] <= 15) & (F.abs(a["top"] - b["top"]) <= 3)
        pairs = F.filter("_left", lambda a: F.exists("_right", lambda b: beside(a, b))).getField("top")
        stops = F.concat(stops, pairs)
    end = F.array_min(F.filter(stops, lambda t: t > F.col("_h") + layout.stop_gap)) - layout.lift
    return found.select("doc", "page", "_h", F.coalesce(end, F.col("_height") - 30).alias("_end"))


def positional_rows(words: DataFrame, layout: WordLayout) -> DataFrame:
    """Operation rows read from word positions (doc, page, text, x0, x1, top).

    Header and end of the table come from one aggregate per page, over the few words
    that can be one; words then move once, by page, and find their row by the
    latest start above them.
    """
    page = ["doc", "page"]
    bounds = _table_span(words, layout)
    inside = words.select(*page, "text", "x0", "top").join(bounds, page).filter(F.col("top") < F.col("_end"))
    a, b, c, d, e, f = layout.starts
    clock, number = F.col("text").rlike(r"^[0-9]{1,2}:[0-9]{2}$"), F.col("text").rlike(r"^[0-9]+(?:\.[0-9]+)?$")
    # a row starts at a clock with another clock and a number beside it; the frame is a little wider than the exact test
    reach = int(layout.tolerance * 100) + 2
    beside = W.partitionBy(*page).orderBy(F.floor(F.col("top") * 100)).rangeBetween(-reach, reach)
    peers = [F.collect_set(F.when(test & _between("x0", low, high), F.col("top"))).over(beside) for test, low, high in ((clock, c, d), (number, e, f))]
    first = clock & _between("x0", a, b) & (F.col("top") > F.col("_h") + layout.gap)
    near = lambda q: F.exists(q, lambda t: F.abs(F.col("top") - t) <= layout.tolerance)
    # words right and left of the table can not start a row, but those at its rim can stand beside a start
    met = inside.select(*page, "text", "x0", "top", first.alias("_first"), *[p.alias(f"_q{n}") for n, p in enumerate(peers)])
    starts = F.col("_first") & near("_q0") & near("_q1")
    kept = (F.col("x0") >= layout.edges[0]) & (F.col("x0") <= layout.edges[-1])
    # a start counts from 3 points above its own top; the row above ends half a
    # point before it, so words in between belong to the later row
    own = F.struct(F.col("top").alias("pos"), F.lit(1).alias("_word"), F.lit(None).cast("double").alias("row_top"))
    begin = F.struct((F.col("top") - 3).alias("pos"), F.lit(0).alias("_word"), F.col("top").alias("row_top"))
    placed = met.select(*page, "text", "x0", "top", F.inline(F.array_compact(F.array(F.when(kept, own), F.when(starts, begin)))))
    above = W.partitionBy(*page).orderBy("pos", "_word").rowsBetween(W.unboundedPreceding, 0)
    owned = placed.withColumn("row", F.last("row_top", ignorenulls=True).over(above)).filter("_word = 1 and row is not null")

    def column(i):
        return (F.col("x0") >= layout.edges[i]) & (F.col("x0") < layout.edges[i + 1])

    word = F.struct(F.round("top", 1).alias("y"), F.col("x0").alias("x"), "text", F.col("top").alias("top"))
    wide = owned.groupBy(*page, "row").agg(
        *[F.array_sort(F.collect_list(F.when(column(i), word))).alias(f"_w{i}") for i in range(len(COLUMNS))]
    )

    def cell(i, name):
        if name != "operation_details":
            found = F.col(f"_w{i}")
            if name in ("from", "to", "hours"):  # one print line, the first one
                top = F.array_min(F.col(f"_w{i}.top"))
                found = F.filter(found, lambda w: F.abs(w["top"] - top) <= layout.tolerance)
            return X.inline(F.array_join(found.getField("text"), " "))
        # details keep their print lines, other cells are one line
        detail = F.aggregate(
            f"_w{i}", F.struct(F.lit("").alias("text"), F.lit(-1.0e9).alias("y")),
            lambda acc, w: F.struct(
                F.when(acc["text"] == "", w["text"])
                .when(F.abs(w["y"] - acc["y"]) <= layout.tolerance, F.concat(acc["text"], F.lit(" "), w["text"]))
                .otherwise(F.concat(acc["text"], F.lit("\n"), w["text"])).alias("text"),
                F.when(F.abs(w["y"] - acc["y"]) <= layout.tolerance, acc["y"]).otherwise(w["y"]).alias("y"),
            ),
        )["text"]
        return X.multiline(detail)

    wide = wide.filter("size(_w0) > 0 and size(_w1) > 0 and size(_w2) > 0")
    wide = wide.select(*page, "row", *[X.repair_ocr(cell(i, n)).alias(n) for i, n in enumerate(COLUMNS)])
    return wide.filter("from <> '' and to <> '' and hours <> ''")


# --- cell grids --------------------------------------------------------------------------------------


def label_text(c: Column) -> Column:
    """Lower case without accents, other signs as blanks."""
    accents = "áàâäãåéèêëíìîïóòôöõúùûüñçý"
    plain = "aaaaaaeeeeiiiiooooouuuuncy"
    low = F.translate(F.lower(S.text(c)), accents, plain)
    return F.trim(F.regexp_replace(low, "[^a-z0-9%/+.-]+", " "))


def merged_fill(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every cell of a merged range takes the value of its top-left cell.

    Only cells at a place (row, col) that some range covers meet the ranges; all
    others stay where they are.  Sheets of one form share their places, so the
    list of places is short and broadcast by its size; a long one is joined, and
    its frequent places are split by AQE.
    """
    area = ranges.select(
        "doc", "sheet", "r1", "c1", F.explode(F.sequence("r1", "r2")).alias("row"), "c2"
    ).select("doc", "sheet", "r1", "c1", "row", F.explode(F.sequence("c1", "c2")).alias("col"))
    at = area.select("row", "col").distinct()
    corners = ranges.select(F.col("r1").alias("row"), F.col("c1").alias("col")).distinct()
    corner = cells.join(corners, ["row", "col"], "left_semi")
    corner = corner.select("doc", "sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("value").alias("_top"))
    filled = area.join(corner, ["doc", "sheet", "r1", "c1"]).select("doc", "sheet", "row", "col", "_top")
    met = cells.join(at, ["row", "col"], "left_semi").join(filled, ["doc", "sheet", "row", "col"], "full_outer")
    met = met.select("doc", "sheet", "row", "col", F.coalesce("_top", "value").alias("value"))
    return met.unionByName(cells.join(at, ["row", "col"], "left_anti").select("doc", "sheet", "row", "col", "value"))


def grid_fields(cells: DataFrame, specs: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc, field, value, row, col): first usable value per field in scan order.

    A label cell gives its own text after a colon, else the nearest value: up
    to 7 cells to the right, then 4 rows down over 3 columns.  Labels are looked
    up as the first and last words of a cell; the value on the right is a window
    of the row.  Only labels without one ask the 12 places below, which are
    looked up by position, not by a range.
    """
    spark = cells.sparkSession
    norms = [(field, i, _norm(label)) for field, labels in specs.items() for i, label in enumerate(labels)]
    labels = spark.createDataFrame(norms, "field string, label_ord int, label string")
    by_words: dict[int, list[str]] = {}
    for n in sorted({n for _, _, n in norms}):
        by_words.setdefault(len(n.split(" ")), []).append(n)

    def label_only(n):
        """Texts whose last words are a label."""
        return reduce(lambda p, q: p | q, [F.substring_index(n, " ", -k).isin(*texts) for k, texts in by_words.items()])

    def named_by(n):
        """The labels that a text begins or ends with, null for the many without one."""
        ends = [(F.substring_index(n, " ", side * k), texts) for k, texts in by_words.items() for side in (1, -1)]
        some = reduce(lambda p, q: p | q, [e.isin(*texts) for e, texts in ends])
        return F.when(some, F.array_distinct(F.array_compact(F.array(*[F.when(e.isin(*texts), e) for e, texts in ends]))))

    sheet, value, norm = ["doc", "sheet"], F.col("value"), F.col("norm")
    at = [*sheet, "row", "col"]
    usable = ~label_only(norm) & ((F.length(norm) > 1) | norm.rlike("^[0-9]$"))
    # cells move once, by document
    grid = cells.filter(~S.blank(value)).select(*at, "value").repartition("doc").withColumn("norm", label_text(value))
    marked = grid.select(*at, "value", named_by(norm).alias("_hits"), usable.alias("_usable"))
    right = W.partitionBy(*sheet, "row").orderBy("col").rangeBetween(1, 7)
    here = F.when(F.col("_usable"), F.struct(value.alias("found"), F.col("row").alias("vrow"), F.col("col").alias("vcol")))
    beside = marked.withColumn("_right", F.first(here, ignorenulls=True).over(right)).filter("_hits is not null").drop("_usable")
    split = beside.withColumn("_clean", F.when(F.contains(value, F.lit(":")), S.squeeze(value)))
    split = split.withColumn("_cut", F.instr("_clean", F.lit(":")))
    split = split.withColumn("_text", F.trim(F.substr("_clean", F.col("_cut") + 1))).withColumn("_norm", label_text(F.col("_text")))
    split = split.withColumn("_left", F.when((F.col("_norm") != "") & ~label_only(F.col("_norm")), label_text(F.substr("_clean", F.lit(1), F.col("_cut") - 1))))
    # the catalogue is small, but a list made on the driver has no known size: without the hint the labels of cells move
    hit = split.select(*at, "_left", "_text", "_right", F.explode("_hits").alias("label")).join(F.broadcast(labels), "label")
    hit = hit.groupBy(*at, "field").agg(F.min_by(F.struct("label", "_left", "_text", "_right"), "label_ord").alias("_m"))
    left, label = F.col("_m._left"), F.col("_m.label")
    inline_ok = F.contains(left, label) | F.contains(label, left)
    own = F.when(inline_ok, F.struct(F.col("_m._text").alias("found"), F.col("row").alias("vrow"), F.col("col").alias("vcol")))
    # label cells are few; they are read for what they have and for what is below them
    hit = materialise(hit.select(*at, "field", F.coalesce(own, F.col("_m._right")).alias("_v")), "labels")
    offsets = [(r, c) for r in range(1, 5) for c in range(0, 3)]
    places = F.array(*[F.struct(F.lit(i).alias("n"), (F.col("row") + r).alias("vrow"), (F.col("col") + c).alias("vcol")) for i, (r, c) in enumerate(offsets)])
    both = hit.filter("_v is not null").select(*at, "field", F.lit(0).alias("n"), "_v")
    asking = hit.filter("_v is null").select(*at, "field")
    if not asking.isEmpty():
        near = asking.select(*at, "field", F.inline(places))
        below = cells.filter(~S.blank(value)).withColumn("norm", label_text(value)).filter(usable)
        values = below.select(*sheet, F.col("row").alias("vrow"), F.col("col").alias("vcol"), value.alias("found"))
        # cells made from few reports look small to the planner, which would send them all to every worker
        low = near.join(values.hint("merge"), [*sheet, "vrow", "vcol"])
        both = both.unionByName(low.select(*at, "field", "n", F.struct("found", "vrow", "vcol").alias("_v")))
    first = both.groupBy("doc", "field").agg(F.min_by("_v", F.struct("sheet", "row", "col", "n")).alias("_v"))
    return first.select("doc", "field", F.col("_v.found").alias("value"), F.col("_v.vrow").alias("row"), F.col("_v.vcol").alias("col"))


def _norm(text: str) -> str:
    import re
    import unicodedata

    flat = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)).lower()
    return re.sub(r"[^a-z0-9%/+.-]+", " ", flat).strip()


def missing_fields(docs: DataFrame, fields: DataFrame, specs: dict[str, tuple[str, ...]]) -> DataFrame:
    """Warnings for fields that were not found in a document."""
    wanted = docs.select("doc", F.explode(F.array(*[F.lit(f) for f in specs])).alias("field"))
    return wanted.join(fields, ["doc", "field"], "left_anti").withColumn("warning", F.concat("field", F.lit(" not found")))


@dataclass(frozen=True)
class GridTable:
    headers: tuple[tuple[str, tuple[str, ...]], ...]
    min_hits: int
    stops: tuple[str, ...] = ()
    continuation: str = ""
    first_pattern: str = ""


# fixed values: tables of the spreadsheet layout (column, its header texts)
GRID_OPERATIONS = GridTable(
    headers=(
        ("from", ("from",)), ("to", ("to",)), ("hours", ("hrs", "hours")), ("op_code", ("op code",)), ("op_sub", ("op sub",)),
        ("op_type", ("op type",)), ("operation_details", ("operation details", "details")),
    ),
    min_hits=5,
    stops=("safety incident", "environ incident", "incident comments", "other remarks"),
    continuation="operation_details",
    first_pattern=r"^[0-9]{1,2}:?[0-9]{0,2}$",
)
GRID_TABLES = {
    "operations": GRID_OPERATIONS,
    "survey_data": GridTable(
        headers=(
            ("md", ("md",)), ("incl", ("incl", "inclination")), ("azi", ("azi", "azimuth")), ("tvd", ("tvd",)), ("vse", ("vse",)),
            ("ns", ("n/-s", "n s", "ns")), ("ew", ("e/-w", "e w", "ew")), ("dls", ("dls",)), ("build", ("build",)),
        ),
        min_hits=5,
        stops=("personnel", "bit record", "mud data"),
    ),
    "bit_record": GridTable(
        headers=(
            ("bit_no", ("bit no",)), ("size", ("size",)), ("manufacturer", ("manufacturer",)), ("model", ("model",)), ("serial_no", ("serial no",)),
            ("iadc_code", ("iadc code",)), ("nozzles", ("nozzles",)), ("md_in", ("md in",)), ("md_out", ("md out",)),
            ("bit_grade", ("b-g-o-r", "b g o r")),
        ),
        min_hits=5,
        stops=("bit operating parameters", "mud data"),
    ),
    "bit_operating_parameters": GridTable(
        headers=(
            ("bit_no", ("bit no",)), ("rot_hrs", ("rot hrs",)), ("cum_rot_hrs", ("cum rot hrs",)), ("progress", ("prog",)),
            ("cum_progress", ("cum prog",)), ("rop", ("rop",)), ("cum_rop", ("cum rop",)), ("wob_min_max", ("wob",)), ("rpm_min_max", ("rpm",)),
            ("tfa", ("tfa",)), ("p_drop_bit", ("p drop bit",)), ("noz_vel", ("noz vel",)), ("hhpsi", ("hhpsi",)),
        ),
        min_hits=5,
        stops=("mud data", "mud products"),
    ),
    "mud_products": GridTable(
        headers=(("product", ("product",)), ("units", ("units",)), ("qty_used", ("qty used",))),
        min_hits=3,
        stops=("last or current bha", "daily costs", "fluid losses"),
    ),
    "bha_components": GridTable(
        headers=(("component", ("component",)), ("od", ("od",)), ("id", ("id",)), ("joints", ("jts", "joints")), ("length", ("length",))),
        min_hits=4,
        stops=("fluid losses", "bulks", "operations", "daily costs"),
        continuation="component",
    ),
    "daily_costs": GridTable(
        headers=(("cost_description", ("cost description",)), ("vendor", ("vendor",)), ("amount", ("amount",))),
        min_hits=3,
        stops=("fluid losses", "bulks", "operations"),
    ),
    "bulks": GridTable(
        headers=(("bulk", ("bulks", "bulk")), ("qty_start", ("qty start",)), ("qty_used", ("qty used",)), ("qty_end", ("qty end",))),
        min_hits=3,
        stops=("operations", "safety incident", "other remarks"),
    ),
}
# columns whose line breaks are kept
LINED = ("operation_details",)


# fixed values: section titles that end any table
SECTION_TITLES = (
    "daily operations report", "survey data", "personnel", "bit record", "bit operating parameters", "mud data", "mud products",
    "last or current bha", "daily costs", "fluid losses", "bulks", "operations", "other remarks",
)


# no column of a sheet lies so far to the right
BEYOND = 1 << 31


def _header_columns(spec: GridTable) -> Column:
    """(col, until, pos, lined) of the headers found in a row, by column.

    A header is the first cell that holds one of its texts; one whose text only
    shows across cells is taken to stand right of the header found before it.  A
    column is taken once and reaches to the next one; ``pos`` is the place of its
    name in the table.
    """
    kind = "array<struct<col:int,pos:int>>"

    def seen(aliases, c):
        return reduce(lambda p, q: p | q, [F.contains(c, F.lit(_norm(a))) for a in aliases])

    def take(found, h):
        right = F.coalesce(F.get(found, F.size(found) - 1)["col"] + 1, F.lit(0))
        col = F.coalesce(h["col"], F.when(h["across"], right)).cast("int")
        new = F.array(F.struct(col.alias("col"), h["pos"].alias("pos"))).cast(kind)
        free = col.isNotNull() & ~F.exists(found, lambda f: f["col"] == col)
        return F.when(free, F.concat(found, new)).otherwise(found)

    def columns(normed):
        wanted = F.array(
            *[
                F.struct(
                    F.get(F.filter(normed, lambda c: seen(aliases, c["norm"])), F.lit(0))["col"].alias("col"),
                    seen(aliases, F.col("line")).alias("across"), F.lit(pos).alias("pos"),
                )
                for pos, (_, aliases) in enumerate(spec.headers)
            ]
        )
        return F.aggregate(wanted, F.array().cast(kind), take)

    lined = [pos for pos, (name, _) in enumerate(spec.headers) if name in LINED]

    def reaching(found):
        return F.transform(
            found,
            lambda c, i: F.struct(
                c["col"].alias("col"), F.coalesce(F.get(found, i + 1)["col"].cast("bigint"), F.lit(BEYOND)).alias("until"),
                c["pos"].alias("pos"), (c["pos"].isin(*lined) if lined else F.lit(False)).alias("lined"),
            ),
        )

    # most rows hold too few of the header texts to be looked at cell by cell
    hits = reduce(lambda p, q: p + q, [any_marker(F.col("line"), tuple(_norm(x) for x in aliases)).cast("int") for _, aliases in spec.headers])
    normed = F.transform("cells", lambda c: F.struct(c["col"].alias("col"), label_text(c["value"]).alias("norm")))
    enough = lambda found: F.when(F.size(found) >= spec.min_hits, X.let(F.array_sort(found), reaching))
    return F.when(hits >= spec.min_hits, X.let(X.let(normed, columns), enough))


def _table_stop(spec: GridTable) -> Column:
    """Rows with a stop marker or another section's title end a table."""
    own_words = " ".join(_norm(a) for _, aliases in spec.headers for a in aliases)
    sections = [t for t in SECTION_TITLES if t not in own_words]
    return any_marker(F.col("line"), tuple(_norm(m) for m in spec.stops)) | F.col("line").isin(*sections)


def grid_lines(cells: DataFrame) -> DataFrame:
    """(doc, sheet, row, cells, raw): one record per sheet row with text; a row has few columns.

    Cells move once, by document, which is one workbook: all later steps of a table
    stay in that partition and sort it, with spill.  A sheet has at most 1,048,576
    rows by its format.
    """
    grid = cells.filter(~S.blank(F.col("value"))).select("doc", "sheet", "row", "col", "value").repartition("doc")
    rows = grid.groupBy("doc", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells"))
    # a text counts if it has a letter or digit; only few rows can hold a title or header, the others need no normal form
    raw = rows.withColumn("raw", F.lower(F.array_join("cells.value", " ")))
    ascii_only = F.octet_length("raw") == F.length("raw")
    return raw.filter(F.when(ascii_only, F.col("raw").rlike("[a-z0-9%/+.-]")).otherwise(label_text(F.col("raw")) != ""))


def _may_hold(texts: tuple[str, ...]) -> Column:
    """Rows whose text can contain one of ``texts`` when normalised: they have its longest word, or signs beside ASCII."""
    return any_marker(F.col("raw"), tuple(dict.fromkeys(max(_norm(t).split(" "), key=len) for t in texts)))


def _may_matter(spec: GridTable) -> Column:
    """Rows that can end a table or be its header."""
    hits = reduce(lambda p, q: p + q, [_may_hold(aliases).cast("int") for _, aliases in spec.headers])
    return (F.octet_length("raw") != F.length("raw")) | (hits >= spec.min_hits) | _may_hold((*spec.stops, *SECTION_TITLES))


def grid_tables(cells: DataFrame, specs: dict[str, GridTable]) -> DataFrame:
    """(doc, table_name, texts, sheet, header_row, row) of the rows of all tables found by their header words.

    ``texts`` follows the headers of the table; a sheet may hold several tables.
    A column reaches to the next header.  A row whose leftmost column lacks the
    pattern of first cells, or that only has text in the continuation column,
    continues the row above; line breaks stay in LINED columns.  Repeated rows are
    dropped, the first one stays.

    All tables are read in one walk down each sheet.  A row with a stop marker,
    and the first one after three rows without text, begins a new stretch; a row
    belongs to every header above it in its stretch.
    """
    sheet, kinds = ["doc", "sheet"], list(specs.values())
    down = W.partitionBy(*sheet).orderBy("row")
    matters = reduce(lambda p, q: p | q, [_may_matter(spec) for spec in kinds])
    lines = grid_lines(cells).withColumn("line", F.when(matters, label_text(F.col("raw"))))
    flags = [c for k, spec in enumerate(kinds) for c in (_table_stop(spec).alias(f"_s{k}"), _header_columns(spec).alias(f"_c{k}"))]
    marked = lines.select(
        *sheet, "row", "cells", *flags,
        (F.coalesce(F.lag("row").over(down), F.lit(-BEYOND)) < F.col("row") - 3).alias("_gap"),
    )
    begun = marked.select(
        *sheet, "row", "cells", *[f"_c{k}" for k in range(len(kinds))],
        *[
            c
            for k in range(len(kinds))
            for c in (
                F.last(F.when(F.col("_gap") | F.col(f"_s{k}"), F.col("row")), ignorenulls=True).over(down).alias(f"_b{k}"),
                F.last(F.when(F.col(f"_c{k}").isNotNull(), F.col("row")), ignorenulls=True).over(down).alias(f"_h{k}"),
            )
        ],
    )
    # rows from the first header of a stretch on, once for each table they are in
    entry = lambda k: F.struct(F.lit(k).alias("_k"), F.col(f"_b{k}").alias("_begin"), F.col(f"_c{k}").alias("_columns"))
    reached = F.array_compact(F.array(*[F.when(F.col(f"_h{k}") >= F.col(f"_b{k}"), entry(k)) for k in range(len(kinds))]))
    reached = begun.select(*sheet, "row", "cells", F.inline(reached))
    above = W.partitionBy(*sheet, "_k", "_begin").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    head = F.when(F.col("_columns").isNotNull(), F.struct(F.col("row").alias("header_row"), F.col("_columns").alias("columns")))
    inside = reached.withColumn("_heads", F.collect_list(head).over(above)).select(*sheet, "_k", "row", "cells", F.inline("_heads"))
    # cells come by column and have text: a row has text in the table if its last cell reaches it
    inside = inside.filter(F.element_at("cells", -1)["col"] >= F.get("columns", F.lit(0))["col"])

    def slice_text(c):
        own = F.filter("cells", lambda x: (x["col"] >= c["col"]) & (x["col"] < c["until"])).getField("value")
        lined = lambda: X.multiline(F.array_join(own, "\n"))
        return F.struct(c["pos"].alias("pos"), F.when(c["lined"], lined()).otherwise(S.squeeze(F.array_join(own, " "))).alias("text"))

    group = [*sheet, "_k", "header_row"]
    texts = inside.select(*group, "row", F.transform("columns", slice_text).alias("_t"))
    by_kind = lambda of: reduce(lambda c, k: c.when(F.col("_k") == k, of(kinds[k])), range(1, len(kinds)), F.when(F.col("_k") == 0, of(kinds[0])))
    place = {spec: [n for n, _ in spec.headers].index(spec.continuation) if spec.continuation else -1 for spec in kinds}
    first = F.get(F.col("_t"), F.lit(0))["text"]

    def opens(spec):
        if spec.first_pattern:
            return first.rlike(spec.first_pattern)
        if spec.continuation:
            return (first != "") | F.exists("_t", lambda t: (t["pos"] != place[spec]) & (t["text"] != ""))
        return F.lit(True)

    owning = W.partitionBy(*group).orderBy("row")
    opened = texts.select(*group, "row", "_t", by_kind(opens).alias("_opens"), (F.row_number().over(owning) == 1).alias("_top"))
    # a row without first cell before any row with one belongs to none; without pattern it is a row of its own
    starts = F.col("_opens") | (F.col("_top") & by_kind(lambda spec: F.lit(bool(spec.continuation and not spec.first_pattern))))
    owned = opened.withColumn("_own", F.last(F.when(starts, F.col("row")), ignorenulls=True).over(owning)).filter("_own is not null")
    whole = F.array_join(F.filter(F.col("_t.text"), lambda t: t != ""), " ")
    base, more = F.col("row") == F.col("_own"), F.col("row") > F.col("_own")
    rows = owned.groupBy(*group, "_own").agg(
        F.first(F.when(base, F.col("_t")), ignorenulls=True).alias("_t"),
        F.array_sort(F.collect_list(F.when(more & by_kind(lambda spec: F.lit(bool(spec.continuation))), F.struct("row", whole.alias("t"))))).alias("_more"),
    )
    by_pos = F.map_from_entries("_t")
    width = by_kind(lambda spec: F.lit(len(spec.headers)))
    at = by_kind(lambda spec: F.lit(place[spec]))
    joined = X.multiline(F.array_join("_more.t", "\n"))

    def filled(m):
        def cell(pos):
            own = F.coalesce(F.try_element_at(m, pos), F.lit(""))
            longer = (pos == at) & (F.size("_more") > 0)
            return F.when(longer, X.multiline(F.concat_ws("\n", F.nullif(own, F.lit("")), joined))).otherwise(own)

        return F.transform(F.sequence(F.lit(0), width - 1), cell)

    named = by_kind(lambda spec: F.lit(list(specs)[kinds.index(spec)]))
    found = rows.select("doc", named.alias("table_name"), X.let(by_pos, filled).alias("texts"), "sheet", "header_row", F.col("_own").alias("row"))
    return dedupe_rows(found, ["table_name", "texts"])


def grid_table(cells: DataFrame, spec: GridTable) -> DataFrame:
    """(doc, a column per header, sheet, header_row, row) of the rows of one kind of table."""
    names = [F.col("texts")[i].alias(n) for i, (n, _) in enumerate(spec.headers)]
    return grid_tables(cells, {"table": spec}).select("doc", *names, "sheet", "header_row", "row")


def dedupe_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """First row of each distinct content per document, whatever its place."""
    rest = [c for c in rows.columns if c not in ("doc", *names)]
    return ordering.first_by(rows, ["doc", *names], [F.col(c) for c in rest], rest)


def raw_cells(cells: DataFrame) -> DataFrame:
    """Non-empty cells with their spreadsheet address (0-based column)."""
    col = F.col("col")
    letter = lambda n: F.char(F.lit(65) + n % 26)
    # one letter up to Z, two from 26 on, three from 26 + 26 * 26 on
    letters = F.concat(
        F.when(col >= 702, letter(F.floor((col - 702) / 676))).otherwise(""),
        F.when(col >= 26, letter(F.floor((col - 26) / 26))).otherwise(""),
        letter(col),
    )
    return cells.filter(~S.blank(F.col("value"))).select(
        "doc", "sheet", F.concat(letters, F.col("row").cast("string")).alias("address"), S.squeeze(F.col("value")).alias("value")
    )
