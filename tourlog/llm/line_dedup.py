"""Line dedup by a tree of log templates.

A line goes down a tree of fixed depth: number of tokens, then its leading
tokens with variable fields (tokens with digits) generalised.  In a leaf that
several documents reach, the tokens of a line are ranked by the number of lines
that have them at their place: the first of them, as many as the share that must
agree, are the constants of its template, all others fields.  Only the order of the
numbers counts, so that the verdict is the same in a leaf of any size.  A line whose
constants do not recur, or of which half is fields, is a template of its own, which
equal lines of any length and place share.
A template that enough documents share is kept in the document with the
smallest id and dropped from the others.

At size: leaves are counted by hashes, texts of lines are only moved for leaves
that recur (by a bitmap of fixed size), equal lines combine before they move, and
decisions come back to a document as the hashes of its dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.llm.likely import likely
from tourlog.llm.storage import written

FIELD = "<*>"
DEPTH = 3
# letters of scripts that set no space between words, and how many of them make
# up a line that is long enough
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
MIN_UNSPACED = 8


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda t: t != "")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def _lines(docs: DataFrame) -> DataFrame:
    """Distinct lines of each document: id, line."""
    lines = F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select(F.col("doc_id").alias("id"), F.explode(lines).alias("line"))


def _leaf(lines: DataFrame, min_tokens: int) -> DataFrame:
    at = lines.withColumn("tokens", _tokens(F.col("line"))).where(F.size("tokens") >= min_tokens)
    return at.withColumn("leaf", F.xxhash64(F.size("tokens"), F.transform(F.slice("tokens", 1, DEPTH), _masked)))


def _equal_lines(docs: DataFrame, min_equal: int, min_tokens: int) -> DataFrame:
    """Lines that are in ``min_equal`` documents byte by byte: (line_hash, template, first_id, n_docs)."""
    long_enough = (F.size(_tokens(F.col("line"))) >= min_tokens) | F.col("line").rlike(f"(?:[{UNSPACED}][^{UNSPACED}]*){{{MIN_UNSPACED}}}")
    hashed = _lines(docs).where(long_enough).select("id", F.xxhash64("line").alias("line_hash"))
    counts = hashed.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id")).where(F.col("n_docs") >= min_equal)
    return counts.select("line_hash", F.col("line_hash").cast("string").alias("template"), "first_id", "n_docs")


def line_templates(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, similarity: float = 0.8, min_equal: int | None = None) -> DataFrame:
    """Lines of recurring templates: (line_hash, template, first_id, n_docs).

    n_docs counts documents and line pairs of the template, first_id is the
    smallest id (null if only rows without id have it).  A line that follows no
    template of ``min_docs`` is one of its own, which takes ``min_equal``.
    """
    equal = _equal_lines(docs, min_equal or min_docs, min_tokens)
    lines = _leaf(_lines(docs), min_tokens)
    counts = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    counts = written(counts, "leaves")
    # equal lines combine in the map tasks; the join then drops what the bitmap let through
    texts = likely(lines, counts, "leaf").groupBy("leaf", F.xxhash64("line").alias("line_hash"), "line").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    # sizes are written with the texts: beside the inline they would be worked out for each token
    width, plain = F.size(_tokens(F.col("line"))), F.size(F.filter(_tokens(F.col("line")), lambda t: ~t.rlike("[0-9]")))
    texts = written(texts.join(counts, "leaf").withColumns({"width": width, "plain": plain}), "leaf-lines")

    tokens = F.filter(F.transform(_tokens(F.col("line")), lambda t, k: F.struct(k.alias("at"), t.alias("token"))), lambda p: ~p["token"].rlike("[0-9]"))
    at = texts.select("leaf", "line_hash", "n", "first_id", "width", "plain", F.inline(tokens))
    # how many lines have a token at its place in the leaf; fewer than min_docs are in no template
    often = at.groupBy("leaf", "at", "token").agg(F.sum("n").alias("seen")).where(F.col("seen") >= min_docs)
    forms = at.join(often, ["leaf", "at", "token"]).groupBy("leaf", "line_hash", "n", "first_id", "width", "plain").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("seen")).alias("rank"), "at", "token"))).alias("parts")
    )
    agree = F.ceil(similarity * F.col("plain")).cast("int")
    forms = forms.where((F.size("parts") >= agree) & (2 * agree >= F.col("width")))
    forms = forms.withColumn("parts", F.array_sort(F.transform(F.slice("parts", 1, agree), lambda p: F.struct(p["at"], p["token"]))))
    gap = lambda n: F.repeat(F.lit(f"{FIELD} "), n.cast("int"))
    before = lambda k: F.coalesce(F.get("parts", k - 1)["at"], F.lit(-1))
    general = F.concat(
        F.array_join(F.transform("parts", lambda p, k: F.concat(gap(p["at"] - before(k) - 1), p["token"])), " "),
        F.repeat(F.lit(f" {FIELD}"), F.col("width") - 1 - F.element_at("parts", -1)["at"]),
    )
    forms = forms.select("leaf", "line_hash", "n", "first_id", general.alias("template"))
    groups = forms.groupBy("leaf", "template").agg(F.sum("n").alias("n_docs"), F.min("first_id").alias("first_id")).where(F.col("n_docs") >= min_docs)
    shared = forms.select("leaf", "template", "line_hash").join(groups, ["leaf", "template"]).select("line_hash", "template", "first_id", "n_docs")
    # the template goes before the equal lines that follow it
    every = shared.withColumn("order", F.lit(0)).unionByName(equal.withColumn("order", F.lit(1)))
    best = every.groupBy("line_hash").agg(F.min(F.struct("order", "template", "first_id", "n_docs")).alias("best"))
    return best.select("line_hash", "best.template", "best.first_id", "best.n_docs")


def line_dedup(docs: DataFrame, min_docs: int = 3, min_tokens: int = 3, similarity: float = 0.8, min_equal: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text and others) with clean_text, n_lines and n_dropped.

    A template takes ``min_docs`` documents, a line that is equal byte by byte
    ``min_equal`` (as many if not given).
    A null text counts as empty and gives an empty clean_text.  Lines of fewer
    than ``min_tokens`` tokens stay, unless they have MIN_UNSPACED letters of
    scripts without spaces and are equal; so do all lines of the document
    with the smallest id of their template; rows without an id come after all
    others and count as one document.  Rows that repeat a doc_id are one
    document.  Lines that stay keep their bytes and order.
    """
    drops = line_templates(docs, min_docs, min_tokens, similarity, min_equal)
    hashed = _lines(docs).select("id", F.xxhash64("line").alias("line_hash"))
    hit = hashed.join(drops.select("line_hash", "first_id"), "line_hash").where(~F.col("id").eqNullSafe(F.col("first_id")))
    per_doc = hit.groupBy("id").agg(F.collect_set("line_hash").alias("line_drops")).withColumnRenamed("id", "line_id")
    found = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["line_id"]), "left").drop("line_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    stays = F.filter(lines, lambda line: ~F.array_contains("line_drops", F.xxhash64(line)))
    found = found.withColumn("line_stays", F.when(F.col("line_drops").isNull(), lines).otherwise(stays))
    return found.select(
        *docs.columns,
        F.array_join("line_stays", "\n").alias("clean_text"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("line_stays")).cast("long").alias("n_dropped"),
    )
