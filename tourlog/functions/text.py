"""Text rules as Column -> Column functions built on Java regular expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S

PLACEHOLDER = r"\[\[P[0-9]+\]\]"
# (?U) makes \b and \w Unicode-aware, as the word lists expect
SPANISH = f"(?iU)[{dims.SPANISH_MARKS}]|\\b(?:{'|'.join(dims.SPANISH_WORDS)})\\b"


def _chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, step: F.regexp_replace(acc, step[0], step[1]), steps, c)


def let(c: Column, body) -> Column:
    """``body`` applied to a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(c), body), 1)


def inline(c: Column) -> Column:
    """Collapse horizontal space, keep line breaks."""
    return S.trimmed(F.regexp_replace(S.text(c), r"[ \t\f\x0B]+", " "))


def multiline(c: Column) -> Column:
    """Tidy every line and drop blank lines at both ends."""
    return S.trimmed(_chain(S.text(c), [(r"\r\n?", "\n"), (r"[ \t\f\x0B]+", " "), (" ?\n ?", "\n")]))


def paragraph(c: Column) -> Column:
    """One line: any run of white space becomes a blank."""
    return S.trimmed(F.regexp_replace(S.text(c), r"(?U)\s+", " "))


def repair_ocr(c: Column) -> Column:
    """Undo scan artefacts that are certain: glued verbs, broken inch fractions,
    spaced thousands.  Anything ambiguous stays as it is."""
    inch = '(?:IN\\b|["”″])'
    verbs = "|".join(dims.OCR_VERBS)
    glued = [(rf"(?i)\b({verbs})([0-9]{{4,}})(?![A-Za-z0-9_])", "$1 $2")]
    thousands = [(r"(?<![0-9,])([0-9]{1,3}),[ \t]+(?=[0-9]{3}(?:[^0-9]|$))", "$1,")]
    inches = [
        (rf"(?i)(?<![0-9])([0-9]{{1,2}})[ \t]*\n[ \t]*([0-9])/([0-9])(?=[ \t]*{inch})", "$1 $2/$3"),
        (rf"(?i)(?<![0-9.])([0-9]{{1,2}})\.([0-9])/([0-9])(?=[ \t]*{inch})", "$1 $2/$3"),
        (rf"(?i)(?<![0-9])([0-9]{{1,2}})[ \t]+([0-9])([0-9])[ \t]*/[ \t]*(?={inch})", "$1 $2/$3"),
    ]
    for symbol, fraction in dims.UNICODE_FRACTIONS.items():
        inches.append((rf"(?i)(?<![0-9])([0-9]{{1,2}})[ \t]*{symbol}(?=[ \t]*{inch})", f"$1 {fraction}"))

    # most texts have no digit, and most others no inch mark: they skip the chain
    def with_inches(t):
        return F.when(t.rlike(f"(?i){inch}"), _chain(t, inches)).otherwise(t)

    def with_digits(t):
        return F.when(t.rlike("[0-9]"), _chain(let(_chain(t, glued), with_inches), thousands)).otherwise(t)

    return let(F.regexp_replace(S.text(c), r"\r\n?", "\n"), with_digits)


def clean_source(df: DataFrame, column: str, out: str, furniture: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: struct(text, actions) of prose without page headers and footers.

    ``furniture`` adds line patterns, e.g. the operator's name, to the fixed
    ones.  Each stage is a column of its own, so that its regular expressions
    run once however often the stage is used.
    """
    letters = f"[{dims.LATIN_CLASS}]"
    pattern = f"(?i)^(?:{'|'.join((*dims.PAGE_FURNITURE, *furniture))})$"
    first, repaired, joined, lines, kept = (F.col(f"_{n}") for n in ("first", "repaired", "joined", "lines", "kept"))
    removed = F.size(lines) - F.size(kept)
    actions = F.array_compact(
        F.array(
            F.when(repaired != first, "normalize_pdf_ocr"),
            F.when(joined != repaired, "join_hyphenated_line_break"),
            F.when(removed > 0, F.concat(F.lit("remove_pdf_header_footer:"), removed.cast("string"))),
        )
    )
    staged = (
        df.withColumn("_first", multiline(F.replace(S.text(F.col(column)), F.lit("\u00ad"), F.lit(""))))
        .withColumn("_repaired", repair_ocr(first))
        .withColumn("_joined", F.regexp_replace(repaired, f"(?<={letters})-\n(?={letters})", ""))
        .withColumn("_lines", F.split(joined, "\n"))
        .withColumn("_kept", F.filter(lines, lambda line: ~F.trim(line).rlike(pattern)))
        .withColumn("_text", F.when(removed > 0, multiline(F.array_join(kept, "\n"))).otherwise(joined))
    )
    result = F.struct(F.col("_text").alias("text"), actions.alias("actions"))
    return staged.withColumn(out, result).drop("_first", "_repaired", "_joined", "_lines", "_kept", "_text")


def detect_language(c: Column) -> Column:
    value = S.text(c)
    return (
        F.when(value.rlike("[一-鿿]"), "zh-CN").when(value.rlike(SPANISH), "es").otherwise("en")
    )


def needs_translation(c: Column, target: str) -> Column:
    value = multiline(F.regexp_replace(S.text(c), PLACEHOLDER, ""))
    if target == "zh-CN":
        letters = F.regexp_count(value, F.lit(f"[{dims.LATIN_CLASS}]"))
        return (value != "") & (letters >= 4) & value.rlike(f"[{dims.LATIN_CLASS}]{{2,}}")
    return (value != "") & (detect_language(value) != target)


def is_text_value(c: Column) -> Column:
    return ~S.blank(c) & S.text(c).rlike(f"[{dims.LATIN_CLASS}一-鿿]")


def technical_literal(c: Column) -> Column:
    """Fragments made only of short capital words or 'x' stay as written."""
    words = F.regexp_extract_all(inline(c), F.lit(f"[{dims.LATIN_CLASS}]+"), F.lit(0))
    return F.forall(words, lambda w: (F.length(w) <= 4) & ((F.upper(w) == w) | (F.lower(w) == "x")))


def unit_id(entity_type: Column, entity_id: Column, field_code: Column) -> Column:
    """Readable id of a text unit: section, row and field."""

    def part(c):
        cleaned = F.regexp_replace(F.regexp_replace(S.trimmed(c), "[^A-Za-z0-9_.-]+", "-"), "^[-.]+|[-.]+$", "")
        return S.pick(cleaned, F.lit("item"))

    field = F.substring_index(field_code, ".", -1)
    header = (entity_type == "daily_report") | field_code.startswith("report_fields.")
    row = S.pick(F.substring_index(entity_id, ":", -1), F.lit("item"))
    return F.when(header, F.concat_ws(":", F.lit("report"), part(field))).otherwise(
        F.concat_ws(":", part(S.pick(entity_type, F.lit("item"))), part(row), part(field))
    )


# --- numbers in prose -------------------------------------------------------------

_FREE = "(?<![A-Za-z0-9_])"
# fixed values: marks after which a dotted three-digit group is a thousand
DEPTH_MARK = r"\s*(?:['’′]|ft\b|feet\b|pies\b|m\b|md\b|tvd\b)"


def _number_forms(c: Column) -> Column:
    """Rewrite the accepted spellings of a number to one form each."""
    inch = '(?:IN\\b|英寸|["”])'
    glued = (f"([{dims.LATIN_CLASS}]{{5,}})([0-9]{{4,}})(?![A-Za-z0-9_])", "$1 $2")
    mixed = [
        # 9 58/IN and 9 58 IN are 9 5/8
        (rf"(?i){_FREE}([0-9]+)\s+([0-9])([0-9])/?(?=\s*{inch})", "$1#$2/$3"),
        # 12-1/4, 12.1/4, 12 1/4
        (rf"{_FREE}([0-9]+)(?:\s+|-\s*|\.)([0-9]+/[0-9]+)", "$1#$2"),
    ]
    symbols = [(rf"{_FREE}([0-9]+)\s*{symbol}", f"$1#{fraction}") for symbol, fraction in dims.UNICODE_FRACTIONS.items()]
    # thousands: each match removes one separator and the next one goes on where it ended
    thousand = rf"({_FREE}[0-9]+|\G[0-9]{{3}}),\s*(?=[0-9]{{3}}(?:,\s*[0-9]{{3}})*(?![0-9]))"
    # a comma with one or two digits is a decimal comma
    commas = [(thousand, "$1"), (rf"{_FREE}([0-9]+),([0-9]{{1,2}})(?![0-9,./])", "$1.$2")]
    depths = (rf"(?i){_FREE}([0-9]{{1,3}})\.([0-9]{{3}})(?={DEPTH_MARK})", "$1$2")

    def gated(c, pattern, steps):
        return let(c, lambda t: F.when(t.rlike(pattern), _chain(t, steps)).otherwise(t))

    out = gated(S.text(c), f"[{dims.LATIN_CLASS}]{{5}}[0-9]{{4}}", [glued])
    out = gated(out, f"(?i)/|[0-9]\\s*{inch}", mixed)
    out = gated(out, f"[{''.join(dims.UNICODE_FRACTIONS)}]", symbols)
    out = gated(out, "[0-9]\\.[0-9]{3}", [depths])
    return gated(out, "[0-9],", commas)


def number_tokens(c: Column) -> Column:
    """Canonical numbers of a text in reading order (mixed fractions as ``12 1/4``)."""
    found = F.regexp_extract_all(
        _number_forms(c), F.lit(rf"{_FREE}(?:[0-9]+#[0-9]+/[0-9]+|[0-9]+(?:[,.][0-9]+)*(?:/[0-9]+)?)"), F.lit(0)
    )
    plain = lambda t: F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)
    return F.transform(found, lambda t: plain(F.translate(t, "#", " ")))


ORDINAL = r"(?i)(?<![A-Za-z0-9_])[0-9]+(?:er|do|ro|to|ta|mo|vo|no)\.?(?![A-Za-z0-9_])"


def without_ordinals(c: Column) -> Column:
    return F.regexp_replace(S.text(c), ORDINAL, " ")


def ordinal_numbers(c: Column) -> Column:
    found = F.regexp_extract_all(S.text(c), F.lit(ORDINAL), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(F.regexp_extract(t, "^[0-9]+", 0), "^0+(?=[0-9])", ""))


# --- calendar dates in prose ---------------------------------------------------------

MONTH_WORDS = {name: number for number, names in dims.MONTHS.items() for name in names}
_MONTH = "(?:" + "|".join(sorted(MONTH_WORDS, key=len, reverse=True)) + ")"
DATE_FORMS = (
    rf"\b[0-9]{{1,2}}(?:st|nd|rd|th)?\s+(?:DE\s+)?{_MONTH}(?:\s+(?:DEL?\s+)?[0-9]{{4}})?\b",
    rf"\b{_MONTH}\s+[0-9]{{1,2}}(?:st|nd|rd|th)?(?:,\s*|\s+)[0-9]{{4}}\b",
    r"(?<![0-9])(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-][0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{4}[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])(?![0-9])",
)
DATE = "(?iU)" + "|".join(DATE_FORMS)


def month_number(c: Column) -> Column:
    lookup = F.create_map(*[F.lit(v) for pair in MONTH_WORDS.items() for v in pair])
    return F.try_element_at(lookup, F.lower(c))


def calendar_dates(c: Column) -> Column:
    """array of struct(year, month, day); a missing year is 0."""
    found = F.regexp_extract_all(S.text(c), F.lit(DATE), F.lit(0))

    def parts(t):
        word = F.regexp_extract(t, f"(?i){_MONTH}", 0)
        year = F.regexp_extract(t, "(?<![0-9])[0-9]{4}(?![0-9])", 0).try_cast("int")
        small = F.regexp_extract_all(t, F.lit("(?<![0-9])[0-9]{1,2}(?![0-9])"), F.lit(0))
        year_first = t.rlike("^[0-9]{4}")
        first, second = F.get(small, F.lit(0)).try_cast("int"), F.get(small, F.lit(1)).try_cast("int")
        worded = F.regexp_extract(t, "[0-9]{1,2}", 0).try_cast("int")
        month = F.when(word != "", month_number(word)).when(year_first, first).otherwise(second)
        day = F.when(word != "", worded).when(year_first, second).otherwise(first)
        return F.struct(
            F.coalesce(year, F.lit(0)).alias("year"), month.alias("month"), day.alias("day"), t.alias("source")
        )

    return F.transform(found, parts)


def month_names(c: Column) -> Column:
    """Numbers of the months named in a text."""
    found = F.regexp_extract_all(S.text(c), F.lit(rf"(?iU)\b{_MONTH}\b"), F.lit(0))
    return F.transform(found, lambda t: month_number(t).cast("string"))


def localized_date(year: Column, month: Column, day: Column, style: str = "iso") -> Column:
    """Target form of a date: ISO or Chinese; without a year always month and day."""
    short = F.concat(month.cast("string"), F.lit("月"), day.cast("string"), F.lit("日"))
    full = (
        F.concat(year.cast("string"), F.lit("年"), short)
        if style == "chinese"
        else F.format_string("%04d-%02d-%02d", year, month, day)
    )
    return F.when(year == 0, short).otherwise(full)


# --- responsible party ------------------------------------------------------------------


def explicit_party(c: Column) -> Column:
    """Company named by an explicit wording; single lines are tried before the whole text."""
    lines = F.filter(F.transform(F.split(S.text(c), r"\r\n?|\n"), S.squeeze), lambda line: line != "")
    candidates = F.concat(lines, F.array(S.squeeze(c)))

    def one(text):
        hits = [F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in dims.PARTY_PATTERNS]
        return F.coalesce(*hits)

    found = F.filter(F.transform(candidates, one), lambda v: v.isNotNull())
    raw = F.get(found, F.lit(0))
    cut = F.get(F.split(raw, f"(?i){dims.PARTY_STOP}", 2), F.lit(0))
    return F.upper(F.coalesce(F.trim(cut, F.lit(" .:-")), F.lit("")))


def normalize_party(value: Column, rig: Column) -> Column:
    """Upper-case company; the rig's own contractor becomes the full rig name."""
    bare = F.trim(F.trim(S.trimmed(value), F.lit('"')))
    cleaned = F.trim(F.regexp_replace(bare, f"(?i){dims.PARTY_PREFIX}", ""), F.lit(" .;:-"))
    company = F.regexp_replace(F.upper(cleaned), "[^A-Z0-9]", "")
    own = F.regexp_replace(F.regexp_replace(F.upper(S.trimmed(rig)), r"[\s_-]*[0-9]+[A-Z]?$", ""), "[^A-Z0-9]", "")
    return (
        F.when((cleaned == "") | F.upper(cleaned).isin(*dims.PARTY_NULLS), "")
        .when((own != "") & (company == own), S.trimmed(rig))
        .otherwise(F.upper(cleaned))
    )
