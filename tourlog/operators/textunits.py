"""Translatable text units of reports, their memory lookup, overlay and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S
from tourlog.functions import text as X


def header_units(headers: DataFrame) -> DataFrame:
    """Prose header fields in reading order; one row per non-empty field."""
    fields = F.array(*[F.lit(f) for f in dims.TEXT_REPORT_FIELDS])
    rows = headers.select("record_id", "report_type", "fields", F.posexplode(fields).alias("place", "field"))
    return (
        rows.withColumn("text", F.try_element_at("fields", F.col("field")))
        .filter(X.is_text_value(F.col("text")))
        .select(
            "record_id", "report_type", F.lit("daily_report").alias("entity_type"), F.col("record_id").alias("entity_id"),
            F.lit("report_fields").alias("section"), F.lit(0).alias("row_no"), "field", "place", "text",
        )
    )


def row_units(rows: DataFrame, section: str, records: DataFrame) -> DataFrame:
    """Prose columns of a detail section, keyed ``record:section:row``."""
    fields = [f for f in dims.TEXT_ROW_FIELDS if f in rows.columns]
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.col(f).alias("text")) for i, f in enumerate(fields)])
    long = rows.select("record_id", "row_no", F.inline(cells)).filter(X.is_text_value(F.col("text")))
    return long.join(records.select("record_id", "report_type"), "record_id").select(
        "record_id", "report_type", F.lit(section).alias("entity_type"),
        F.concat_ws(":", "record_id", F.lit(section), F.col("row_no").cast("string")).alias("entity_id"),
        F.lit(section).alias("section"), "row_no", "field", "place", "text",
    )


def coded(units: DataFrame) -> DataFrame:
    """Field code, path and readable id of each unit."""
    code = F.concat_ws(".", "section", "field")
    path = F.when(F.col("section") == "report_fields", code).otherwise(
        F.concat(F.col("section"), F.lit("["), (F.col("row_no") - 1).cast("string"), F.lit("]."), F.col("field"))
    )
    out = units.withColumn("field_code", code).withColumn("path", path)
    return out.withColumn("unit_id", X.unit_id(F.col("entity_type"), F.col("entity_id"), F.col("field_code")))


def in_scope(units: DataFrame, scope: DataFrame) -> DataFrame:
    """Units allowed by scope rows (report_type or '*', section or '*', field).

    The wildcards are expanded on the unit side, so the join is on equal keys.
    """
    types = F.explode(F.array(F.col("report_type"), F.lit("*")))
    sections = F.explode(F.array(F.col("section"), F.lit("*")))
    keys = units.select("entity_id", "field_code", "field", types.alias("s_type"), "section")
    keys = keys.select("entity_id", "field_code", F.col("field").alias("s_field"), "s_type", sections.alias("s_section"))
    rules = scope.select(
        F.col("report_type").alias("s_type"), F.col("section").alias("s_section"), F.col("field").alias("s_field")
    ).distinct()
    # a header field never matches a section wildcard
    hits = keys.join(rules, ["s_type", "s_section", "s_field"]).filter(
        ~((F.col("s_section") == "*") & F.col("field_code").startswith("report_fields."))
    )
    return units.join(hits.select("entity_id", "field_code").distinct(), ["entity_id", "field_code"], "left_semi")


def memory_lookup(hashes: DataFrame, memory: DataFrame, content: DataFrame, language: str, version: str, report_type: str) -> DataFrame:
    """Best known translation per source hash in two tiers.

    Tier one is confirmed memory (typed before generic, then newest); tier two
    finished content of the same prompt version (manual first, then newest).
    Both tiers reduce by ``max_by`` in the map tasks, so a text that was stored
    millions of times costs one row per task.
    """
    wanted = hashes.select("source_hash").filter("source_hash <> ''").distinct()
    confirmed = memory.filter(
        (F.col("target_language") == language)
        & (F.col("confirmed") == "true")
        & ~S.blank(F.col("translated_text"))
    )
    if report_type:
        confirmed = confirmed.filter(F.col("report_type").isin("", report_type))
    rank1 = F.struct((F.col("report_type") != "").alias("typed"), "updated_at", "translated_text")
    tier1 = confirmed.groupBy("source_hash").agg(F.max_by("translated_text", rank1).alias("text1"))
    done = content.filter(
        (F.col("target_language") == language)
        & (F.col("prompt_version") == version)
        & (F.col("translation_status") == "COMPLETED")
        & (F.col("source_hash") != "")
        & ~S.blank(F.col("translated_text"))
    )
    rank2 = F.struct((F.col("is_manual_modified") != "").alias("manual"), "updated_at", "translated_text")
    tier2 = done.groupBy("source_hash").agg(F.max_by("translated_text", rank2).alias("text2"))
    return (
        wanted.join(tier1, "source_hash", "left")
        .join(tier2, "source_hash", "left")
        .select(
            "source_hash", F.coalesce("text1", "text2").alias("translated_text"),
            F.when(F.col("text1").isNotNull(), 1).otherwise(2).alias("tier"),
        )
        .filter("translated_text is not null")
    )


def memory_search(memory: DataFrame, query: str = "", report_type: str = "", limit: int = 200) -> DataFrame:
    """Newest entries that contain the text; the limit (1 to 1000) is the feature."""
    out = memory
    q = query.strip()
    if q:
        out = out.filter(F.col("source_text").contains(q) | F.col("translated_text").contains(q))
    if report_type.strip():
        out = out.filter(F.col("report_type") == report_type.strip().lower())
    return out.orderBy(F.desc("updated_at"), F.desc("id")).limit(max(1, min(limit or 200, 1000)))


def unchanged_error(source: Column, translated: Column) -> Column:
    """'' or why a translation cannot be accepted as one."""
    fold = lambda c: F.lower(X.paragraph(F.regexp_replace(S.text(c), X.PLACEHOLDER, "")))

    def judge(pair):
        s, t = pair["s"], pair["t"]
        same = (s == t) | ((F.length(s) >= 20) & F.contains(t, s))
        return F.when(s == "", "").when(same, "source text was returned unchanged").otherwise("")

    compared = X.let(F.struct(fold(source).alias("s"), fold(translated).alias("t")), judge)
    return F.when(S.blank(translated), "missing translated_text").otherwise(compared)


def translation_plan(units: DataFrame, memory: DataFrame, target: str, furniture: tuple[str, ...] = ()) -> DataFrame:
    """Disposition of every unit: not required, known from memory, or pending.

    ``memory`` is (source_hash, translated_text), one row per hash.
    """
    source = units.withColumn("source_text", X.multiline(F.col("text"))).filter("source_text <> ''")
    base = (
        X.clean_source(source, "source_text", "_c", furniture)
        .withColumn("clean_text", S.pick(F.col("_c.text"), F.col("source_text")))
        .withColumn("source_hash", S.source_hash(F.col("source_text")))
        .withColumn("source_language", X.detect_language(F.col("clean_text")))
    )
    joined = (
        base.join(memory.select("source_hash", F.col("translated_text").alias("_known")), "source_hash", "left")
        .withColumn("_known", S.trimmed(F.col("_known")))
        .withColumn("_required", X.needs_translation(F.col("clean_text"), target))
        .withColumn("_usable", (F.col("_known") != "") & (unchanged_error(F.col("clean_text"), F.col("_known")) == ""))
        .withColumn("_literal", X.technical_literal(F.col("clean_text")))
    )
    required, usable, literal = F.col("_required"), F.col("_usable"), F.col("_literal")
    return joined.select(
        *units.columns, "source_hash", "source_language",
        F.when(~required, F.col("clean_text")).when(usable, F.col("_known")).when(literal, F.col("clean_text"))
        .otherwise("").alias("translated_text"),
        F.when(~required, "NOT_REQUIRED").when(usable, "COMPLETED").when(literal, "NOT_REQUIRED").otherwise("PENDING").alias("disposition"),
    )


def payload_language(units: DataFrame) -> DataFrame:
    """Language of the first five units of each report, Spanish when there is no text."""
    from tourlog.operators import ordering

    order = [F.col("section") != "report_fields", F.col("section"), F.col("row_no"), F.col("place")]
    first = ordering.top_rows(units, ["record_id"], order, 5, "_rank")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "text"))), lambda x: x["text"]), " ")
    texts = first.groupBy("record_id").agg(joined.alias("_t"))
    return texts.select("record_id", F.when(S.blank(F.col("_t")), "es").otherwise(X.detect_language(F.col("_t"))).alias("language"))


def usable_rows(content: DataFrame, language: str) -> DataFrame:
    return content.filter(
        (S.normalize_language(F.col("target_language")) == language)
        & F.col("translation_status").isin("COMPLETED", "NOT_REQUIRED")
    )


def apply_translations(units: DataFrame, content: DataFrame, language: str) -> DataFrame:
    """Units with the stored translation laid over, where it is still of this text."""
    rows = usable_rows(content, language).filter("translated_text <> ''").select(
        "entity_id", "field_code", F.col("translated_text").alias("_new"), F.col("source_hash").alias("_hash")
    )
    current = (F.col("_hash") == "") | (F.col("_hash") == S.source_hash(X.multiline(F.col("text"))))
    return (
        units.join(rows, ["entity_id", "field_code"], "left")
        .withColumn("shown_text", F.when(current, F.col("_new")).otherwise(F.col("text")))
        .withColumn("shown_text", F.coalesce("shown_text", "text"))
        .drop("_new", "_hash")
    )


def coverage_rows(units: DataFrame, content: DataFrame, language: str) -> DataFrame:
    """Required units with a flag whether a valid translation of this text exists."""
    rows = usable_rows(content, language).select("entity_id", "field_code", F.col("source_hash").alias("_hash"))
    required = units.filter(X.needs_translation(F.col("text"), language))
    done = F.coalesce(F.col("_hash") == S.source_hash(X.multiline(F.col("text"))), F.lit(False))
    return required.join(rows, ["entity_id", "field_code"], "left").select("record_id", "path", done.alias("done"))


def coverage(units: DataFrame, content: DataFrame, language: str) -> DataFrame:
    """Per report: required and completed units and readiness.

    The missing paths stay a table of their own (``coverage_rows`` without
    done); a list per report would be as long as the report.
    """
    return coverage_rows(units, content, language).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("required_count"), F.count_if("done").alias("completed_count"),
        F.bool_and("done").alias("ready"),
    )


def report_context(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Non-empty context values of each report and its rows per module."""
    names = {
        "report_date": "reportDate", "report_number": "reportNo", "wellbore": "wellbore", "rig": "rig",
        "operation_event": "event", "primary_reason": "primaryReason",
    }
    pairs = [v for out, f in names.items() for v in (F.lit(out), F.try_element_at("fields", F.lit(f)))]
    context = F.map_filter(F.create_map(*pairs), lambda k, v: F.coalesce(v, F.lit("")) != "")
    heads = headers.select("record_id", "report_type", context.alias("context"))
    counts = module_row_counts(rows).groupBy("record_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("module_name", "n")))).alias("module_row_counts")
    )
    return heads.join(counts, "record_id", "left")


def module_row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("record_id", "module_name").agg(F.count(F.lit(1)).alias("n"))


def split_parts(c: Column, max_chars: int) -> Column:
    """Cut a long text at sentence, word or hard limits into parts of ``max_chars``.

    Each step peels one part off the front; the parts in order hold the whole
    text except for the blanks at the cuts.
    """
    state = "struct<rest:string,parts:array<string>>"
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(c) / F.lit(max(1, max_chars // 2)))) + 1)
    start = F.struct(c, F.array().cast("array<string>")).cast(state)

    def cut_at(rest):
        window = F.substring(rest, 1, max_chars + 1)
        ends = F.regexp_instr(F.reverse(window), F.lit(r" [.;?!]|[-+*] "))
        sentence = F.when(ends > 0, F.length(window) - ends).otherwise(0)
        blank = F.locate(" ", F.reverse(window))
        word = F.when(blank > 0, F.length(window) - blank + 1).otherwise(0)
        chosen = F.when(sentence >= max_chars // 2, sentence).otherwise(word)
        return F.when(chosen <= 1, max_chars).otherwise(chosen)

    def peel(acc, _):
        at = cut_at(acc["rest"])
        long = F.length(acc["rest"]) > max_chars
        part = F.trim(F.when(long, F.substr(acc["rest"], F.lit(1), at)).otherwise(acc["rest"]))
        rest = F.when(long, F.trim(F.substr(acc["rest"], at + 1))).otherwise("")
        return F.struct(
            rest.alias("rest"), F.when(part == "", acc["parts"]).otherwise(F.concat(acc["parts"], F.array(part))).alias("parts")
        ).cast(state)

    return F.aggregate(steps, start, peel)["parts"]


def split_layout(c: Column, max_chars: int) -> Column:
    """Parts of at most ``max_chars`` with the separator before each: array of struct(separator, text).

    The tidied text is cut into atoms: lines, and pieces of longer lines that end at
    the last sentence or list mark of their second half, else at the last blank,
    else after ``max_chars``.  Atoms are packed greedily.  All parts with their
    separators joined are the tidied text again.  One pattern cuts the whole text
    in one pass.
    """
    half, most = max_chars // 2, max_chars
    piece = (
        rf"[^\n]{{1,{most}}}(?=\n|\z)"  # what is left of a line
        rf"|[^\n]{{{half},{most - 1}}}(?:[.;?!](?= )|(?= [-+*]))"
        rf"|[^\n]{{1,{most}}}(?= )"
        rf"|[^\n]{{{most}}}"
    )
    pattern = F.lit(rf"(\n+| |)({piece})")

    def parts(text):
        cut = F.struct(F.regexp_extract_all(text, pattern, F.lit(1)).alias("before"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("atoms"))
        return X.let(cut, lambda x: _packed(x["before"], x["atoms"], max_chars))

    one = F.array(F.struct(F.lit("").alias("separator"), X.multiline(c).alias("text")))
    return X.let(X.multiline(c), lambda t: F.when(F.length(t) > max_chars, parts(t)).otherwise(one))


def _packed(before: Column, atoms: Column, max_chars: int) -> Column:
    """Greedy parts of atoms; the fold only keeps the place at which each part begins."""
    state = "struct<chars:int,place:int,starts:array<int>>"
    begin = F.struct(F.lit(0), F.lit(0), F.array().cast("array<int>")).cast(state)

    def step(acc, a):
        longer = acc["chars"] + F.length(a["before"]) + F.length(a["atoms"])
        new = (acc["place"] == 0) | (longer > max_chars)
        return F.struct(
            F.when(new, F.length(a["atoms"])).otherwise(longer).alias("chars"), (acc["place"] + 1).alias("place"),
            F.when(new, F.concat(acc["starts"], F.array(acc["place"]))).otherwise(acc["starts"]).alias("starts"),
        ).cast(state)

    def part(starts, s, k):
        size = F.coalesce(F.get(starts, k + 1), F.size(atoms)) - s
        # the separator before a part is not in it
        inner = F.concat(F.array(F.lit("")), F.slice(before, s + 2, size - 1))
        text = F.array_join(F.zip_with(inner, F.slice(atoms, s + 1, size), lambda b, a: F.concat(b, a)), "")
        return F.struct(F.when(k == 0, "").otherwise(F.get(before, s)).alias("separator"), text.alias("text"))

    folded = F.aggregate(F.arrays_zip(before.alias("before"), atoms.alias("atoms")), begin, step)["starts"]
    return X.let(folded, lambda starts: F.transform(starts, lambda s, k: part(starts, s, k)))


def join_layout(parts: Column, translated: Column) -> Column:
    """Translated texts of all parts, in order, with the separators of their parts."""
    texts = F.transform(translated, X.multiline)
    return X.multiline(F.array_join(F.zip_with(parts, texts, lambda p, t: F.concat(p["separator"], t)), ""))
