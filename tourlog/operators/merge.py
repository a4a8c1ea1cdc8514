"""Table maintenance: every merge takes snapshots and returns new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S


def last_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The batch as if applied in order: the last row per key remains."""
    rest = [c for c in batch.columns if c not in keys]
    best = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], keep: tuple = (), sticky: tuple = ()) -> DataFrame:
    """Full-outer merge on unique keys.

    ``keep`` columns are never changed by an update, ``sticky`` ones only while
    they are empty; all others take the new value.  Columns absent from the
    batch stay as they are.
    """
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest], F.lit(True).alias("_old"))
    fresh = [c for c in rest if c in batch.columns]
    new = batch.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fresh], F.lit(True).alias("_new"))
    both = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in fresh:
            return F.col(f"_o_{c}")
        was, now = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in keep:
            return F.when(F.col("_old"), was).otherwise(now)
        if c in sticky:
            return F.when(F.col("_old") & (F.col("_new").isNull() | (was != "")), was).otherwise(now)
        return F.when(F.col("_new"), now).otherwise(was)

    return both.select(*keys, *[value(c).alias(c) for c in rest])


LOCK_COLUMNS = ("locked", "confirmation_status", "confirmed_at", "confirmed_by", "confirmation_note")


def split_batch(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): unknown types and locked reports are refused with a reason."""
    locks = stored.select("record_id", S.truthy(F.col("locked")).alias("_locked"))
    checked = batch.join(locks, "record_id", "left").withColumn(
        "reason",
        F.when(S.blank(F.col("record_id")), "missing id")
        .when(S.normalize_report_type(F.col("report_type")).isNull(), "unsupported report_type")
        .when(F.col("_locked"), "locked"),
    ).drop("_locked")
    good = checked.filter("reason is null").drop("reason")
    return good.withColumn("report_type", S.normalize_report_type(F.col("report_type"))), checked.filter("reason is not null")


def upsert_records(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or update headers; lock columns and the creation time survive updates."""
    return upsert(stored, batch, ["record_id"], keep=(*LOCK_COLUMNS, "created_at"))


def replace_detail_rows(rows: DataFrame, batch_ids: DataFrame, new_rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Drop all rows of the batch's records, add the new rows of declared modules.

    ``batch_ids`` has (record_id, report_type); ``declared`` the modules of each type.
    """
    # an id that comes twice in a batch replaces its rows once
    ids = batch_ids.groupBy("record_id").agg(F.max("report_type").alias("report_type"))
    kept = rows.join(ids, "record_id", "left_anti")
    fresh = new_rows.join(ids, "record_id").join(declared, ["report_type", "module_name"], "left_semi")
    return kept.unionByName(fresh.select(*rows.columns))


def upsert_translation(stored: DataFrame, batch: DataFrame) -> DataFrame:
    keys = ["record_id", "entity_id", "field_code", "target_language"]
    keep = ("entity_type", "source_language", "created_at", "model_config_id")
    return upsert(stored, batch, keys, keep=keep, sticky=("is_manual_modified",))


MEMORY_KEY = ["target_language", "source_hash", "report_type", "field_code"]


def save_memory(memory: DataFrame, entries: DataFrame, now: str, checked: bool = False) -> DataFrame:
    """Upsert translation memory by scope; id, creation time and use count stay.

    New entries get a stable id from their scope key instead of a counter, so
    no task has to hand out numbers.  Entries without text are refused;
    ``checked`` ones come with their hash and are all taken as they are.
    """
    ready = entries
    if not checked:
        valid = entries.filter(~S.blank(F.col("source_text")) & ~S.blank(F.col("translated_text")))
        ready = (
            valid.withColumn("source_text", S.trimmed(F.col("source_text")))
            .withColumn("translated_text", S.trimmed(F.col("translated_text")))
            .withColumn("target_language", S.pick(S.trimmed(F.col("target_language")), F.lit("zh-CN")))
            .withColumn("source_hash", S.pick(S.trimmed(F.col("source_hash")), S.source_hash(F.col("source_text"))))
            .withColumn("report_type", F.lower("report_type"))
        )
    ready = (
        ready.withColumn("confirmed", F.when(S.truthy(F.col("confirmed")), "true").otherwise("false"))
        .withColumn("id", F.xxhash64(*MEMORY_KEY))
        .withColumn("usage_count", F.lit(0))
        .withColumn("created_at", F.lit(now))
        .withColumn("updated_at", F.lit(now))
    )
    return upsert(memory, ready, MEMORY_KEY, keep=("id", "created_at", "usage_count"))


def revise_translations(content: DataFrame, revisions: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(content, history rows, memory entries) after manual revisions.

    A revision of a row that does not exist, or with blank text, has no effect.
    """
    keys = ["record_id", "entity_id", "field_code", "target_language"]
    wanted = revisions.withColumn("revised_text", S.trimmed(F.col("revised_text"))).filter("revised_text <> ''")
    # of revisions of one text the last one counts: by ``order`` if there is one
    order = [c for c in ("order",) if c in revisions.columns] or ["revised_text"]
    wanted = last_per_key(wanted, keys, order)
    joined = content.join(wanted.select(*keys, "revised_text", "editor", "note"), keys, "left")
    hit = F.col("revised_text").isNotNull()
    new = {
        "translated_text": F.col("revised_text"), "translation_status": F.lit("COMPLETED"), "error_message": F.lit(""),
        "is_manual_modified": F.lit("true"), "updated_at": F.lit(now),
    }
    updated = joined.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in content.columns]
    )
    changed = joined.filter(hit)
    history = changed.select(
        *keys, "source_text", F.col("translated_text").alias("previous_text"), "revised_text",
        F.lit("manual").alias("revision_type"), "editor", "note", F.lit(now).alias("created_at"),
    )
    memory = changed.select(
        "source_language", "target_language", "source_text", "source_hash",
        F.col("revised_text").alias("translated_text"), "field_code", F.col("record_id").alias("source_record_id"),
        F.lit("true").alias("confirmed"), F.col("editor").alias("confirmed_by"),
    )
    return updated, history, memory


def reset_translations(records: DataFrame, content: DataFrame, ids: DataFrame | None, now: str) -> tuple[DataFrame, DataFrame]:
    """(records, content): selected reports, or all, lose their translations and wait again."""
    if ids is None:
        marked, left = records.withColumn("_hit", F.lit(True)), content.filter(F.lit(False))
    else:
        marked = records.join(ids.select("record_id", F.lit(True).alias("_hit")).distinct(), "record_id", "left")
        left = content.join(ids, "record_id", "left_anti")
    new = {
        "translation_status": "PENDING", "translation_progress": "0", "translation_error": "", "translation_version": "",
        "translation_updated_at": now,
    }
    kept = [
        F.when(F.col("_hit"), F.lit(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in records.columns
    ]
    return marked.select(*kept), left


def save_extractions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    keys = ["record_id", "rule_id", "source_section", "source_row_no", "target_field"]
    cut = batch.withColumn("error_message", F.substring("error_message", 1, 500))
    return upsert(stored, cut, keys, keep=("source_field",))


def cascade_delete(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted reports."""
    return {name: df.join(ids, "record_id", "left_anti") for name, df in tables.items()}


def upsert_remarks(remarks: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Key to remark of at most 500 characters; a blank remark deletes the key."""
    latest = last_per_key(batch.filter(~S.blank(F.col("remark_key"))), ["remark_key"], order)
    new = latest.select("remark_key", F.substring(S.trimmed(F.col("remarks")), 1, 500).alias("remarks"))
    return upsert(remarks, new, ["remark_key"]).filter("remarks <> ''")


def replace_language_slice(content: DataFrame, fresh: DataFrame, language: str) -> DataFrame:
    """Rows of one language are dropped and the new ones appended."""
    kept = content.filter(S.normalize_language(F.col("target_language")) != language)
    return kept.unionByName(fresh.select(*content.columns))


def backfill(
    records: DataFrame, rows: DataFrame, legacy: DataFrame, legacy_rows: DataFrame, declared: DataFrame, order: list[str], report_type: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rows, failures) after a copy of a legacy store, whole or of one type.

    Legacy reports without id or type are passed by.  Others are saved one after
    another by ``order``: what is refused is a failure with its reason and stops
    nothing, the rest replaces header values and all detail rows.
    """
    named = legacy.filter(~S.blank(F.col("record_id")) & ~S.blank(F.col("report_type")))
    if report_type:
        named = named.filter(F.col("report_type") == report_type)
    good, bad = split_batch(records, last_per_key(named, ["record_id"], order))
    merged = upsert_records(records, good.drop(*order))
    details = replace_detail_rows(rows, good.select("record_id", "report_type"), legacy_rows, declared)
    return merged, details, bad.select("record_id", "reason")


def declared_modules(spark) -> DataFrame:
    """Detail modules that each report type stores."""
    # fixed values: modules per report type
    modules = {
        "drilling": ("survey_data", "bha_components", "operations", "daily_costs", "bulks"),
        "completion": ("operations", "bulks", "daily_costs", "mud_products", "perforation_intervals"),
        "workover": ("operations", "bulks", "daily_costs", "mud_products", "perforation_intervals"),
        "move": ("operations",),
    }
    rows = [(t, m) for t in dims.REPORT_TYPES for m in modules[t]]
    return spark.createDataFrame(rows, "report_type string, module_name string")
