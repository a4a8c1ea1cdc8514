"""Evidence extraction from operation texts, driven by rule rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.functions import dims
from tourlog.functions import scalars as S
from tourlog.functions import text as X
from tourlog.operators import lookups


def extraction_units(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Each enabled rule meets the rows of its section and field.

    ``texts`` has record_id, report_type, section, row_no, field, text, op_type.
    The join key is (section, field); the report type is the residual.
    """
    npt_only = (F.col("target_field") == "service_line") | F.upper("condition").contains("NPT")
    wanted = rules.filter("enabled").select(
        "rule_id", F.col("report_type").alias("_type"), F.col("source_section").alias("section"),
        F.col("source_field").alias("field"), "target_field", npt_only.alias("_npt"),
    )
    joined = texts.join(wanted, ["section", "field"])
    fits = ((F.col("_type") == "all") | (F.col("_type") == F.col("report_type"))) & ~S.blank(F.col("text"))
    right_type = ~F.col("_npt") | (F.col("section") == "report_fields") | (F.col("op_type") == "NPT")
    return (
        joined.filter(fits & right_type)
        .withColumn("text", S.trimmed(F.col("text")))
        .withColumn("source_hash", S.source_hash(F.col("text")))
        .drop("_type", "_npt")
    )


def evidence_text(units: DataFrame, translations: DataFrame) -> DataFrame:
    """Units with their exact current translation and the text given to a model."""
    entity = F.when(F.col("section") == "report_fields", F.col("record_id")).otherwise(
        F.concat_ws(":", "record_id", "section", F.col("row_no").cast("string"))
    )
    coded = units.withColumn("entity_id", entity).withColumn("field_code", F.concat_ws(".", "section", "field"))
    rows = lookups.extraction_reference(coded, translations)
    # fixed values: headings of the evidence text
    ref = F.when(F.col("reference") != "", F.concat(F.lit("\n\n中文参考译文（仅辅助理解）：\n"), "reference")).otherwise("")
    return rows.withColumn("prompt_text", F.concat(F.lit("作业原文：\n"), "text", ref))


def todo(units: DataFrame, results: DataFrame, version: str, overwrite: bool = False) -> DataFrame:
    """Units that still need work, with the number of the coming attempt."""
    keys = {"record_id": "record_id", "rule_id": "rule_id", "source_section": "section", "source_row_no": "row_no",
            "target_field": "target_field"}
    old = results.select(
        *[F.col(k).alias(v) for k, v in keys.items()], F.col("extraction_status").alias("_status"),
        F.col("source_hash").alias("_hash"), F.col("rule_version").alias("_version"), F.col("attempt_count").alias("_n"),
    )
    joined = units.join(old, list(keys.values()), "left")
    done = (F.col("_status") == "COMPLETED") & (F.col("_hash") == F.col("source_hash")) & (F.col("_version") == version)
    left = joined if overwrite else joined.filter(~F.coalesce(done, F.lit(False)))
    return left.withColumn("attempt_count", F.coalesce("_n", F.lit(0)) + 1).drop("_status", "_hash", "_version", "_n")


def evidence_party(c: Column, aliases: tuple[tuple[str, str], ...]) -> Column:
    """Company by explicit wording, else by a known name next to a cause word.

    ``aliases`` are (pattern, canonical) in order of preference; an empty
    canonical keeps the matched spelling with dashes.
    """
    upper = F.upper(S.squeeze(c))

    def hit(pattern, canonical):
        found = F.regexp_extract(upper, pattern, 0)
        shown = F.lit(canonical) if canonical else F.replace(F.regexp_replace(found, r"\s*/\s*", "-"), F.lit(" "), F.lit("-"))
        return F.when(found != "", shown)

    named = F.coalesce(*[hit(p, name) for p, name in aliases]) if aliases else F.lit(None).cast("string")
    by_cause = F.when(upper.rlike(dims.PARTY_CAUSE), named)
    return S.pick(X.explicit_party(c), by_cause)


def extract_party(units: DataFrame, records: DataFrame, aliases: tuple[tuple[str, str], ...]) -> DataFrame:
    """Responsible party per unit; rows without evidence wait for the model stage."""
    found = units.withColumn("_party", evidence_party(F.col("text"), aliases))
    rows = found.join(records.select("record_id", "rig"), "record_id")
    return rows.select(
        "record_id", "row_no", F.when(F.col("_party") == "", "").otherwise(X.normalize_party(F.col("_party"), F.col("rig"))).alias("result_text"),
        F.when(F.col("_party") == "", "PENDING").otherwise("COMPLETED").alias("extraction_status"),
    )


def infer(df: DataFrame, fn, schema: str) -> DataFrame:
    """The model seam: ``fn`` maps Arrow batches (as pandas frames) to results.

    Without ``fn`` rows pass unchanged, as the built-in no-op engine does.
    """
    if fn is None:
        return df
    return df.mapInPandas(lambda frames: (fn(frame) for frame in frames), schema)
