"""Failed translations sorted into families, and the pool of suggestions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S
from tourlog.operators import ordering

EVIDENCE_CHARS = 800


def missing_tokens(error: Column) -> Column:
    """Distinct quoted values of the ``missing=[...]`` lists, at most 20."""
    lists = F.regexp_extract_all(error, F.lit(r"(?i)missing=(\[[^\]]*\])"), F.lit(1))
    quoted = F.flatten(F.transform(lists, lambda t: F.regexp_extract_all(t, F.lit("'([^']*)'"), F.lit(1))))
    return F.slice(F.array_distinct(F.filter(F.transform(quoted, S.trimmed), lambda t: t != "")), 1, 20)


def looks_like_acronym(token: Column) -> Column:
    kept = F.regexp_replace(token, "[^A-Za-z0-9&/-]", "")
    letters = F.regexp_replace(token, "[^A-Za-z]", "")
    return (kept != "") & (letters != "") & (F.length(kept) <= 20) & (F.upper(letters) == letters)


def classify(failed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per failure, or per missing token of it, with family and action.

    ``dictionary`` lists protected texts as (kind, value): unit, acronym or
    proper_noun.  The scope columns are blank where the fix applies everywhere.
    """
    error, low = F.col("error_message"), F.col("_low")
    # columns of their own, so that no rule reads a text twice; most errors have no list of tokens
    read = failed.withColumn("_low", F.lower("error_message"))
    read = read.withColumn("_missing", F.when(low.contains("missing=["), missing_tokens(error)).otherwise(F.array().cast("array<string>")))
    tokens = F.col("_missing")
    transient = functools.reduce(lambda a, b: a | b, [low.contains(word) for word in dims.TRANSIENT_ERROR.split("|")])
    family = (
        F.when(transient, "transient_provider")
        .when(low.contains("unit") & (F.size(tokens) > 0), "unit")
        .when(low.contains("numeric") | error.contains("数字"), "contextual_numeric_regression")
        .when(low.contains("protected placeholder"), "placeholder_provider_regression")
        .when(
            low.contains("protected-part") & low.contains("source text was returned unchanged"),
            "deterministic_protected_fragment",
        )
        .when(low.contains("protected term") & (F.size(tokens) > 0), "term")
        .otherwise("semantic_or_completeness")
    )
    staged = read.withColumn("_family", family).withColumn(
        "_tokens", F.when(F.col("_family").isin("unit", "term"), tokens).otherwise(F.array(F.lit("")))
    )
    # no list is empty here; the outer form keeps Spark from a filter that reads all texts once more
    rows = staged.withColumn("token", F.explode_outer("_tokens")).withColumn("_low", F.lower("token"))
    known = dictionary.groupBy(F.lower(F.trim("value")).alias("_low")).agg(
        F.bool_or(F.col("kind") == "unit").alias("_unit"),
        F.bool_or(F.col("kind").isin("acronym", "proper_noun")).alias("_term"),
    )
    # most failures share the blank token, so they do not move to it
    joined = rows.join(F.broadcast(known), "_low", "left")
    is_unit, is_term = F.coalesce("_unit", F.lit(False)), F.coalesce("_term", F.lit(False))
    unit, term, acronym = F.col("_family") == "unit", F.col("_family") == "term", F.col("_acronym")
    category = (
        F.when(unit & ~is_unit, "missing_protected_unit")
        .when(unit, "contextual_unit_regression")
        .when(term & is_term, "protected_term_regression")
        .when(term & acronym, "missing_protected_acronym")
        .when(term, "missing_protected_proper_noun")
        .otherwise(F.col("_family"))
    )
    action = (
        F.when(unit & ~is_unit, "add_protected_unit")
        .when(term & ~is_term & acronym, "add_protected_acronym")
        .when(term & ~is_term, "add_protected_proper_noun")
        .otherwise("retry_current_rules")
    )
    named = joined.withColumn("_acronym", F.when(term & ~is_term, looks_like_acronym(F.col("token"))).otherwise(False))
    named = named.withColumn("_action", action)
    token = F.when(F.col("_family") == "contextual_numeric_regression", "数字与精度").otherwise(F.col("token"))
    scoped = F.col("_action") == "retry_current_rules"
    return named.select(
        "record_id", F.col("field_code").alias("row_field"), "source_text", "error_message", "row_no",
        category.alias("category"), F.col("_action").alias("action_type"), token.alias("token"),
        F.when(scoped, F.col("report_type")).otherwise("").alias("report_type"),
        F.when(scoped & (F.col("_family") != "transient_provider"), F.col("field_code")).otherwise("").alias("field_code"),
        F.when(F.col("_family") == "semantic_or_completeness", "medium").otherwise("high").alias("confidence"),
    )


def family_key() -> Column:
    """The text that a fingerprint is taken of; failures are grouped by it and only families are hashed."""
    parts = F.col("category"), F.col("action_type"), F.lower("token"), F.lower("report_type"), F.lower("field_code")
    return F.concat_ws("|", *parts)


def fingerprint() -> Column:
    return F.sha2("_family", 256)


def families(issues: DataFrame) -> DataFrame:
    """Failures per family with counts; ids and evidence stay tables of their own."""
    names = "category", "action_type", "token", "report_type", "field_code"
    counted = issues.withColumn("_family", family_key()).groupBy(
        "_family", "category", "action_type", F.lower("token").alias("token"), "report_type", "field_code"
    ).agg(F.count(F.lit(1)).alias("occurrence_count"), F.countDistinct("record_id").alias("record_count"))
    return counted.select(fingerprint().alias("fingerprint"), *names, "occurrence_count", "record_count")


def family_members(issues: DataFrame, k: int = 100) -> DataFrame:
    """The first ``k`` reports and fields of each family, in order (the stored lists end there)."""
    keyed = issues.withColumn("_family", family_key())

    def firsts(col, name):
        seen = keyed.filter(S.text(F.col(col)) != "").groupBy("_family", F.lower(col).alias("_low")).agg(
            F.min(F.struct("record_id", "row_no")).alias("_at"), F.min_by(col, F.struct("record_id", "row_no")).alias("value")
        )
        top = ordering.top_rows(seen, ["_family"], [F.col("_at"), F.col("_low")], k)
        return top.select(fingerprint().alias("fingerprint"), F.lit(name).alias("kind"), "rank", "value")

    return firsts("record_id", "record").unionByName(firsts("row_field", "field"))


def evidence(issues: DataFrame, k: int = 8) -> DataFrame:
    """The last ``k`` failures of each family with cut texts."""
    keyed = issues.withColumn("_family", family_key())
    last = ordering.top_rows(keyed, ["_family"], [F.desc("record_id"), F.desc("row_no"), F.col("row_field")], k)
    return last.select(
        fingerprint().alias("fingerprint"), "rank", "record_id", F.col("row_field").alias("field_code"),
        F.substring("source_text", 1, EVIDENCE_CHARS).alias("source_text"),
        F.substring("error_message", 1, EVIDENCE_CHARS).alias("error_message"),
    )


def merge_suggestions(pool: DataFrame, found: DataFrame, now: str) -> DataFrame:
    """Fold new families into the pool (one row per fingerprint on both sides).

    An applied or verified suggestion that shows up again counts a regression;
    anything not queued waits again; counts add; lists unite, ignoring case, up
    to 100 entries, and evidence keeps the last 8.
    """
    from tourlog.operators.terms import string_list

    old = pool.select("fingerprint", *[F.col(c).alias(f"_{c}") for c in pool.columns if c != "fingerprint"])
    both = old.join(found.withColumn("_new", F.lit(True)), "fingerprint", "full_outer")
    known, new = F.col("_status").isNotNull(), F.coalesce("_new", F.lit(False))
    again = known & new
    empty = F.array().cast("array<string>")

    def united(c, cap):
        whole = F.concat(F.coalesce(F.col(f"_{c}"), empty), F.coalesce(F.col(c), empty))
        return F.slice(string_list(whole), 1, cap)

    proof = F.concat(F.coalesce(F.col("_evidence"), empty), F.coalesce(F.col("evidence"), empty))
    last8 = F.slice(proof, F.greatest(F.lit(1), F.size(proof) - 7), 8)
    regressed = again & F.col("_status").isin("APPLIED", "VERIFIED")
    return both.select(
        "fingerprint",
        F.when(~known, "PENDING").when(again & (F.col("_status") != "QUEUED"), "PENDING").otherwise(F.col("_status")).alias("status"),
        (F.coalesce("_regression_count", F.lit(0)) + regressed.cast("int")).alias("regression_count"),
        (F.coalesce("_occurrence_count", F.lit(0)) + F.coalesce("occurrence_count", F.lit(0))).alias("occurrence_count"),
        F.when(again, united("record_ids", 100)).otherwise(F.coalesce("_record_ids", "record_ids")).alias("record_ids"),
        F.when(again, last8).otherwise(F.coalesce("_evidence", "evidence")).alias("evidence"),
        F.when(~known, now).otherwise(F.col("_first_seen_at")).alias("first_seen_at"),
        F.when(new, now).otherwise(F.col("_last_seen_at")).alias("last_seen_at"),
    )


def verify_suggestions(pool: DataFrame, statuses: DataFrame, finished: DataFrame, now: str) -> DataFrame:
    """Applied suggestions whose reports are all completed become verified.

    ``finished`` lists the reports just completed; a suggestion is looked at
    only when it names one of them.
    """
    # the pool is read once: its row travels beside its ids, at a key that no other row shares
    row = F.struct(*[F.col(c) for c in pool.columns])
    ids = F.when(F.col("status") == "APPLIED", F.filter(F.col("record_ids"), lambda r: r != ""))
    ids = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda r: F.struct(r.alias("record_id"), F.when(F.lit(False), row).alias("row")))
    entries = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("record_id"), row.alias("row"))), ids)
    listed = pool.select("fingerprint", F.explode(entries).alias("_e")).select("fingerprint", "_e.record_id", F.col("_e.row").alias("_row"))
    keyed = listed.withColumn("_key", F.coalesce("record_id", "fingerprint"))
    states = statuses.select(F.col("record_id").alias("_key"), F.col("status").alias("_status"))
    marked = finished.select(F.col("record_id").alias("_key"), F.lit(True).alias("_fin")).distinct()
    named = F.col("record_id").isNotNull()
    checked = (
        keyed.join(states, "_key", "left")
        .join(marked, "_key", "left")
        .groupBy("fingerprint")
        .agg(
            F.bool_and(F.when(named, F.coalesce(F.col("_status") == "COMPLETED", F.lit(False)))).alias("_all"),
            F.max(F.when(named & F.col("_fin"), F.col("record_id"))).alias("_by"),
            F.first("_row", ignorenulls=True).alias("_row"),
        )
    )
    hit = F.coalesce(F.col("_all") & F.col("_by").isNotNull(), F.lit(False))
    return checked.select("_row.*", "_all", "_by").select(
        *[
            F.when(hit, "VERIFIED").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in pool.columns
        ],
        F.when(hit, F.col("_by")).otherwise("").alias("verified_record_id"),
        F.when(hit, now).otherwise("").alias("verified_at"),
    )
