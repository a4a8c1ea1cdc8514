"""Queues and states of the background text jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S
from tourlog.operators import ordering


def job_status(c: Column) -> Column:
    return F.upper(F.trim(S.pick(c, F.lit("PENDING"))))


def needs_work(status: Column, version: Column, current: str, retry: tuple[str, ...] = dims.QUEUE_RETRY) -> Column:
    """Whether a record waits for its job: never while queued, always after a
    failure, otherwise when it was done under another version."""
    return (
        F.when(status.isin(*dims.QUEUE_DONE), False)
        .when(status.isin(*retry), True)
        .otherwise(F.lit(bool(current)) & (S.text(version) != current))
    )


def translation_queue(records: DataFrame, current: str) -> DataFrame:
    status, version = job_status(F.col("translation_status")), S.text(F.col("translation_version"))
    r = dims.QUEUE_REASONS
    reason = (
        F.when(status == "FAILED", S.pick(F.col("translation_error"), F.lit(r["FAILED"])))
        .when(status == "STOPPED", r["STOPPED"])
        .when(status == "QUEUED", r["QUEUED"])
        .when(status == "IN_PROGRESS", r["IN_PROGRESS"])
        .when((version != "") & (version != current), r["STALE"])
        .when(status == "COMPLETED", r["COMPLETED"])
        .otherwise(r["PENDING"])
    )
    return records.select(
        "record_id", status.alias("status"), version.alias("version"),
        needs_work(status, version, current).alias("needs_work"), reason.alias("reason"),
        S.labelled(F.col("report_type"), dims.REPORT_TYPE_LABELS).alias("report_type_label"),
    )


def extraction_queue(records: DataFrame, unit_ids: DataFrame, current: str) -> DataFrame:
    """Only reports with at least one unit; done under another version shows as stale."""
    status, version = job_status(F.col("extraction_status")), S.text(F.col("extraction_version"))
    stale = (version != "") & F.lit(bool(current)) & (version != current) & (status == "COMPLETED")
    return records.join(unit_ids, "record_id", "left_semi").select(
        "record_id", F.when(stale, "STALE").otherwise(status).alias("status"), version.alias("version"),
        needs_work(status, version, current, (*dims.QUEUE_RETRY, "STALE")).alias("needs_work"),
    )


def queue_summary(queue: DataFrame) -> DataFrame:
    busy = F.col("status").isin("QUEUED", "IN_PROGRESS")
    return queue.agg(
        F.count(F.lit(1)).alias("records"), F.count_if("needs_work").alias("pending_count"),
        F.count_if(busy).alias("processing_count"), F.coalesce(F.bool_or(busy), F.lit(False)).alias("is_running"),
    )


def active_counts(records: DataFrame) -> DataFrame:
    def busy(c):
        return F.count_if(F.upper(F.trim(c)).isin("QUEUED", "IN_PROGRESS"))

    counts = records.agg(busy("translation_status").alias("translation"), busy("extraction_status").alias("extraction"))
    return counts.withColumn("total", F.col("translation") + F.col("extraction"))


# a message adds at least one character and two of separator, so later ones
# cannot reach into the first 500 characters of the joined text
MAX_MESSAGES = 500 // 3 + 1


def first_messages(rows: DataFrame, key: str, message: str, order: str) -> DataFrame:
    """Distinct messages per key by first occurrence, joined and cut at 500 characters."""
    firsts = rows.filter(S.text(F.col(message)) != "").groupBy(key, message).agg(F.min(order).alias("_at"))
    top = ordering.top_rows(firsts, [key], [F.col("_at"), F.col(message)], MAX_MESSAGES, "_rank")
    listed = F.array_sort(F.collect_list(F.struct("_rank", message)))
    joined = F.array_join(F.transform(listed, lambda x: x[message]), "; ")
    return top.groupBy(key).agg(F.substring(joined, 1, 500).alias("error"))


def record_status(units: DataFrame, records: DataFrame, status: str, order: str) -> DataFrame:
    """Roll unit states up to reports: failed share, progress and messages.

    Reports without units need nothing and are at 100.
    """
    failed = F.col(status) == "FAILED"
    sums = units.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"))
    errors = first_messages(units.filter(failed), "record_id", "error_message", order)
    percent = F.bround((F.col("n") - F.col("bad")) / F.col("n") * 100).cast("int")
    return (
        records.select("record_id")
        .join(sums, "record_id", "left")
        .join(errors, "record_id", "left")
        .select(
            "record_id",
            F.when(F.col("n").isNull(), "NOT_REQUIRED").when(F.col("bad") > 0, "FAILED").otherwise("COMPLETED").alias("status"),
            F.when(F.col("bad") > 0, percent).otherwise(100).alias("progress"),
            F.coalesce("error", F.lit("")).alias("error"),
        )
    )


def queue_records(records: DataFrame, current: str, mode: str, selected: DataFrame | None = None) -> DataFrame:
    """Outcome per report: queued (to reset first when overwriting) or skipped."""
    rows = records if selected is None else records.join(selected, "record_id", "left_semi")
    status = F.upper(F.trim(S.text(F.col("translation_status"))))
    skip = status.isin(*dims.QUEUE_DONE)
    if mode == "continue":
        skip = skip | ~needs_work(job_status(F.col("translation_status")), F.col("translation_version"), current)
    elif mode != "overwrite":
        raise ValueError(f"unknown mode: {mode}")
    return rows.filter("record_id <> ''").select(
        "record_id", F.when(skip, "skipped").otherwise("queued").alias("outcome"),
        (~skip & F.lit(mode == "overwrite")).alias("reset"),
    )


def signature(units: DataFrame, key: str, *parts: str) -> DataFrame:
    """Per-key fingerprint of a set of units, built from sums of row hashes.

    The rows carry their own place (path or row number) inside ``parts``, so a
    sum that ignores arrival order still changes with any edit; it combines in
    the map tasks and never gathers the units of one key.
    """
    signed = signatures(units, key, {"": F.lit(True)}, *parts)
    return signed.select(key, F.col("_units").alias("unit_count"), F.col("_sig").alias("signature"))


def signatures(units: DataFrame, key: str, subsets: dict[str, Column], *parts: str) -> DataFrame:
    """Fingerprints ``<name>_sig`` and counts ``<name>_units`` of several subsets of the units of a key.

    The units are read and hashed once for all subsets; a subset without any
    unit of a key has nulls.
    """
    row = F.sha2(F.to_json(F.struct(*parts)), 256)
    lanes = [F.conv(F.substring(row, 1 + 15 * n, 15), 16, 10).cast("decimal(20,0)").alias(f"_lane{n}") for n in range(3)]
    hashed = units.select(key, *lanes, *[F.coalesce(test, F.lit(False)).alias(f"_in_{name}") for name, test in subsets.items()])

    def signed(name):
        held = F.col(f"_in_{name}")
        count = F.count_if(held)
        sums = [F.sum(F.when(held, F.col(f"_lane{n}"))) for n in range(3)]
        some = count > 0
        return F.when(some, F.sha2(F.concat_ws(":", count, *sums), 256)).alias(f"{name}_sig"), F.when(some, count).alias(f"{name}_units")

    return hashed.groupBy(key).agg(*[c for name in subsets for c in signed(name)])


def requeue_on_change(
    incoming: DataFrame, stored: DataFrame, auto_translate: bool, auto_extract: bool, rule_version: str
) -> DataFrame:
    """State of both jobs for each incoming report.

    ``incoming`` has record_id with t_sig, t_units, e_sig, e_units; ``stored``
    the same signatures plus the current states.  An unchanged report keeps its
    states; a changed one waits again or needs nothing.
    """
    old = stored.select("record_id", *[F.col(c).alias(f"_{c}") for c in stored.columns if c != "record_id"])
    both = incoming.join(old.withColumn("_known", F.lit(True)), "record_id", "left")
    known = F.coalesce("_known", F.lit(False))
    same_text = F.col("t_sig").eqNullSafe(F.col("_t_sig"))
    invalid = ~known | ~same_text | F.lit(auto_translate)
    has_text = F.coalesce("t_units", F.lit(0)) > 0
    waiting = F.when(has_text, "QUEUED" if auto_translate else "PENDING").otherwise("NOT_REQUIRED")
    old_version = S.text(F.col("_extraction_version"))
    e_changed = ~known | ~F.col("e_sig").eqNullSafe(F.col("_e_sig")) | ((old_version != "") & (old_version != rule_version))
    has_units = F.coalesce("e_units", F.lit(0)) > 0
    return both.select(
        "record_id",
        invalid.alias("translations_invalid"),
        F.when(invalid, waiting).otherwise(S.text(F.col("_translation_status"))).alias("translation_status"),
        F.when(has_units & e_changed, "QUEUED" if auto_extract else "PENDING")
        .when(~has_units, "NOT_REQUIRED")
        .otherwise(S.text(F.col("_extraction_status")))
        .alias("extraction_status"),
        F.when(has_units, e_changed & known)
        .otherwise(known & (F.coalesce("_e_units", F.lit(0)) > 0))
        .alias("clear_results"),
    )
