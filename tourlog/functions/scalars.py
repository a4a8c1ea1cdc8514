"""Scalar rules as Column -> Column functions; all stay inside the JVM.

Reports keep every value as text, so the numeric and date rules check the shape
of a text before any cast (``try_cast`` alone would accept ``'1d'``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tourlog.functions import dims

CLOCK_TEXT = "^[0-9]{1,2}:[0-9]{2}$"
NUMBER_TEXT = r"[-+]?[0-9][0-9,]*(\.[0-9]+)?"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


# fixed values: the characters that count as white space at the ends of a text
WHITE_SPACE = " \t\n\r\x0b\x0c\xa0\u3000"


def trimmed(c: Column) -> Column:
    """Trim every kind of white space, not only blanks (no regex involved)."""
    return F.trim(text(c), F.lit(WHITE_SPACE))


def blank(c: Column) -> Column:
    return trimmed(c) == ""


def pick(*cols: Column) -> Column:
    """First value that is not the empty string; blanks such as ' ' do count."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cols], F.lit(""))


# --- numbers -------------------------------------------------------------------


def without(c: Column, mark: str) -> Column:
    """Text without a one-character mark; untouched texts skip the rewrite."""
    return F.when(F.contains(c, F.lit(mark)), F.translate(c, mark, "")).otherwise(c)


def float_or_null(c: Column) -> Column:
    """Number of a text or null; a cast alone would also take '1d' or 'NaN'."""
    plain = F.trim(without(text(c), ","))
    return F.when(F.translate(plain, "0123456789+-.eE", "") == "", plain.try_cast("double"))


def safe_float(c: Column) -> Column:
    return F.coalesce(float_or_null(c), F.lit(0.0))


def trim_number(c: Column) -> Column:
    short = F.regexp_replace(F.regexp_replace(c, "0+$", ""), r"\.$", "")
    return F.when(c.contains("."), F.when(short == "", "0").otherwise(short)).otherwise(c)


def normalize_number(value: Column, label: Column) -> Column:
    """struct(value, warning): plain numbers pass, known units are dropped."""
    raw = trimmed(value)
    plain = F.translate(raw, ",", "")
    number = F.regexp_extract(raw, NUMBER_TEXT, 0)
    at = F.instr(raw, number)
    rest = F.concat(F.substr(raw, F.lit(1), at - 1), F.lit(" "), F.substr(raw, at + F.length(number)))
    rest = F.trim(F.regexp_replace(F.lower(rest), r"[\s,./()@:-]+", " "))
    known = F.forall(F.split(rest, " "), lambda part: part.isin(*dims.NUMBER_UNITS))
    short = trim_number(F.regexp_replace(number, ",", ""))
    return (
        F.when(raw == "", _valued(F.lit(""), F.lit("")))
        .when(plain.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), _valued(trim_number(plain), F.lit("")))
        .when(number == "", _valued(raw, F.concat(label, F.lit(" number invalid"))))
        .when((rest == "") | known, _valued(short, F.lit("")))
        .otherwise(_valued(short, F.concat(label, F.lit(" number corrected"))))
    )


def _valued(value: Column, warning: Column) -> Column:
    return F.struct(value.alias("value"), warning.alias("warning"))


def bounded_int(value: Column, low: int, high: int, default: int) -> Column:
    parsed = float_or_null(value).cast("int")
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(parsed, F.lit(default))))


def truthy(c: Column) -> Column:
    return F.lower(trimmed(c)).isin("1", "true", "yes", "y", "on")


# --- dates and clock times -------------------------------------------------------


def strict_date(c: Column) -> Column:
    """Date of a year-month-day text, null when it is not a calendar day."""
    raw = text(c)
    return F.when(
        raw.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_timestamp(raw, F.lit("yyyy-M-d")).cast("date")
    )


# fixed values: accepted date layouts, first match wins (pattern, layout)
DATE_LAYOUTS = (
    ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    ("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "M-d-yyyy"),
)


def normalize_date(value: Column, label: Column, as_of: str) -> Column:
    """struct(value, warning); ``as_of`` replaces the wall clock."""
    raw = trimmed(value)
    parsed = F.coalesce(
        *[F.when(raw.rlike(p), F.try_to_timestamp(raw, F.lit(f)).cast("date")) for p, f in DATE_LAYOUTS]
    )
    iso = F.date_format(parsed, "yyyy-MM-dd")
    return (
        F.when(raw == "", _valued(F.lit(""), F.lit("")))
        .when(parsed.isNull(), _valued(raw, F.concat(label, F.lit(" date invalid"))))
        .when(iso > as_of, _valued(iso, F.concat(label, F.lit(" is in the future"))))
        .otherwise(_valued(iso, F.lit("")))
    )


def clock_minutes(value: Column) -> Column:
    raw = F.replace(trimmed(value), F.lit("："), F.lit(":"))
    hour = F.substring_index(raw, ":", 1).try_cast("int")
    minute = F.right(raw, F.lit(2)).try_cast("int")
    legal = ((hour == 24) & (minute == 0)) | ((hour <= 23) & (minute <= 59))
    return F.when(raw.rlike(CLOCK_TEXT) & legal, hour * 60 + minute)


def normalize_time(value: Column, label: Column) -> Column:
    raw = trimmed(value)
    minutes = clock_minutes(value)
    hhmm = F.format_string("%02d:%02d", F.floor(minutes / 60), minutes % 60)
    return (
        F.when(raw == "", _valued(F.lit(""), F.lit("")))
        .when(minutes.isNull(), _valued(raw, F.concat(label, F.lit(" time invalid"))))
        .otherwise(_valued(hhmm, F.lit("")))
    )


def clock_hours(start: Column, end: Column, hours: Column) -> Column:
    """Length of one operation in hours, from its start and end minutes.

    Read row by row a report's clock runs on over midnight: each start is moved
    by whole days past the previous end, and the end past its start.  The days
    carried over cancel out in ``end - start``, so the length depends on the
    row alone and needs neither an order nor a group: the start counts modulo
    one day, an earlier end wraps once, and equal times mean a full day only
    when at least 23.9 hours are reported.
    """
    span = end - start % 1440
    wraps = (span < 0) | ((span == 0) & (hours >= 23.9))
    return (span + wraps.cast("int") * 1440) / 60


def date_from_slashes(value: Column, day_first: bool) -> Column:
    pattern = "([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    one, two, year = (F.regexp_extract(text(value), pattern, i) for i in (1, 2, 3))
    month, day = (two, one) if day_first else (one, two)
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year == "", F.lit("")).otherwise(iso)


# --- rigs, operation types, labels ---------------------------------------------------


def canonical_rig(c: Column, contractor: str) -> Column:
    """One spelling per rig; ``contractor`` is the prefix that gets tidied."""
    squeezed = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    short = F.regexp_replace(squeezed, rf"(?i)^00\s+({contractor}\b)", "$1")
    return F.regexp_replace(short, rf"(?i)\b{contractor}[-\s]*([0-9]+)\b", f"{contractor} $1")


def valid_rig(canonical: Column) -> Column:
    upper = F.upper(text(canonical))
    return ~((upper == "") | upper.contains(dims.INVALID_RIG_MARKER) | upper.isin(*dims.INVALID_RIG_NAMES))


def effective_op_type(confirmed: Column, op_type: Column, system: Column) -> Column:
    return F.upper(trimmed(pick(confirmed, op_type, system)))


def system_op_type(system: Column, op_type: Column) -> Column:
    return F.upper(trimmed(pick(system, op_type)))


def either(a: Column, b: Column, sep: str, none: str = "") -> Column:
    """``a sep b`` when both are set, else the one that is, else ``none``."""
    both = F.concat_ws(sep, *[F.nullif(trimmed(c), F.lit("")) for c in (a, b)])
    return pick(both, F.lit(none))


def op_category(code: Column, sub: Column) -> Column:
    return either(code, sub, " / ", dims.NO_CATEGORY)


def time_range(start: Column, end: Column) -> Column:
    return either(start, end, " - ")


def contract_label(contract: Column, project: Column) -> Column:
    same = trimmed(contract) == trimmed(project)
    return F.when(same & ~blank(contract), trimmed(contract)).otherwise(either(contract, project, " / ", "-"))


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(trimmed(c), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", "unknown").otherwise(dashed)


def natural_record_id(*parts: Column) -> Column:
    """``type:well:date:number`` or '' when any part is blank."""
    missing = reduce(lambda a, b: a | b, [blank(p) for p in parts])
    return F.when(missing, F.lit("")).otherwise(F.concat_ws(":", *[slug(p) for p in parts]))


def labelled(c: Column, labels: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(F.try_element_at(lookup, c), c)


def normalize_report_type(c: Column) -> Column:
    """Known type in lower case, else null (the caller rejects those rows)."""
    low = F.lower(trimmed(c))
    return F.when(low.isin(*dims.REPORT_TYPES), low)


def normalize_language(c: Column, default: str = "zh-CN") -> Column:
    low = F.replace(F.lower(trimmed(c)), F.lit("_"), F.lit("-"))
    return (
        F.when(low.isin("zh", "zh-cn", "cn", "中文"), "zh-CN")
        .when(low.isin("en", "english", "eng"), "en")
        .when(low.isin("es", "spanish", "spa") | low.startswith("es"), "es")
        .when(low == "", default)
        .otherwise(low)
    )


def normalize_op_code(c: Column, layout: str) -> Column:
    clean = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    compact = F.regexp_replace(F.upper(clean), "[^A-Z]", "")
    rules = dims.OP_CODE_PREFIXES[layout]
    out = None
    if layout == "drilling":
        out = F.when(compact.contains("BHA") & compact.startswith("CODE"), "BHA")
    for prefix, canonical in rules:
        out = (F.when if out is None else out.when)(compact.startswith(prefix), canonical)
    fallback = F.element_at(F.split(clean, " "), 1) if layout == "drilling" else clean
    return out.otherwise(fallback)


def normalize_op_type(c: Column, layout: str) -> Column:
    upper = F.regexp_replace(F.upper(text(c)), r"\s+", "")
    plain = {"drilling": ("P", "TYPEP")}.get(layout, ("P", "SC"))
    known = F.when(upper.isin(*plain), F.lit("P") if layout == "drilling" else upper)
    return F.when(upper.contains("NPT"), "NPT").otherwise(F.coalesce(known, F.lit("")))


# --- field splitting --------------------------------------------------------------------


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def first_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text(c), NUMBER_TEXT, 0), ",", "")


def split_slash(c: Column, parts: int) -> Column:
    bits = F.split(text(c), "/")
    return F.array(*[squeeze(F.get(bits, F.lit(i))) for i in range(parts)])


def join_slash(*cols: Column) -> Column:
    return F.concat_ws(" / ", *[trimmed(c) for c in cols])


def split_at(c: Column, marker: str) -> Column:
    at = F.instr(text(c), F.lit(marker))
    left = F.when(at > 0, F.substr(text(c), F.lit(1), at - 1)).otherwise(text(c))
    right = F.when(at > 0, F.substr(text(c), at + len(marker))).otherwise(F.lit(""))
    return F.struct(squeeze(left).alias("left"), squeeze(right).alias("right"))


def value_between(line: Column, start: str, stop: str) -> Column:
    """Text between a label and the next one, '' when the label is absent."""
    at = F.instr(line, F.lit(start))
    tail = F.substr(line, at + len(start))
    cut = F.instr(tail, F.lit(stop)) if stop else F.lit(0)
    body = F.when(cut > 0, F.substr(tail, F.lit(1), cut - 1)).otherwise(tail)
    return F.when(at > 0, squeeze(F.regexp_replace(body, "^[ :]+|[ :]+$", ""))).otherwise(F.lit(""))


def source_hash(c: Column) -> Column:
    return F.sha2(text(c), 256)


def row_revision(fields: Column) -> Column:
    """Version token of a row map: equal rows give equal tokens in any key order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))), 256)


def json_or_empty(c: Column) -> Column:
    """Text map of a JSON object; bad or missing JSON gives an empty map."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.from_json(c, "map<string,string>"), empty)
