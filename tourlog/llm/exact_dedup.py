"""Exact dedup by naming blocks: equal texts, and only they, get equal names.

The normalised text is cut into blocks of a fixed number of bytes.  All
distinct blocks of the corpus are sorted and get integer names; then adjacent
names are paired, the distinct pairs sorted and named again, until one name is
left of each document.  Two documents have the same name exactly if all their
blocks are equal: names come from the sorted contents, never from a digest
alone.

At size: a text is shuffled once, as distinct blocks.  The way back from an
occurrence to its name goes by a 64-bit hash of the block.  Blocks that share a
hash with another block (found while sorting) are looked up by their content.
Copies combine in the map tasks, so that a group of any size costs one row for
each map task.  The rounds after the first move only integers, and only of
documents longer than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tourlog.llm.storage import written

# the characters that the comparison ignores
WHITE_SPACE = r"[\x20\x09-\x0D]+"
# levels fit into the low bits of a name
LEVEL_BITS = 6


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _blocks(block_bytes: int, hash_buckets: int | None) -> Column:
    """Array of (h, block) of the binary column ``content``; one empty block of an empty text."""
    h = "xxhash64(substring(content, i * {b} + 1, {b}))".format(b=block_bytes)
    if hash_buckets:
        h = f"pmod({h}, {hash_buckets})"
    return F.expr(
        f"transform(sequence(0, greatest(cast(ceil(octet_length(content) / {block_bytes}.0) as int), 1) - 1), "
        f"i -> named_struct('h', {h}, 'block', substring(content, i * {block_bytes} + 1, {block_bytes})))"
    )


def _numbered(rows: DataFrame, order: list[str], level: int) -> DataFrame:
    """Name rows by their place in the sorted partitions; the low bits hold the level."""
    ranked = rows.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())
    return ranked.withColumn("name", F.col("name") * (1 << LEVEL_BITS) + level)


def name_blocks(contents: DataFrame, block_bytes: int, hash_buckets: int | None = None) -> DataFrame:
    """Names of the distinct blocks of ``content``: (h, name, block); block is null where h tells it alone."""
    pieces = contents.select(F.explode(_blocks(block_bytes, hash_buckets)).alias("p")).select("p.h", "p.block")
    sets = pieces.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    alone = F.size("blocks") == 1
    rows = sets.select("h", alone.alias("alone"), F.explode("blocks").alias("content"))
    rows = rows.select("h", "content", F.when(~F.col("alone"), F.col("content")).alias("block"))
    return written(_numbered(rows, ["h", "content"], 0).select("h", "name", "block"), "block-names")


def name_documents(docs: DataFrame, block_bytes: int = 16384, hash_buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): rid, doc_id, n_points, text_sha256, name.

    ``hash_buckets`` narrows the block hash; tests use it to force hashes that
    several blocks share.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.char_length("text").cast("long").alias("n_points"), normalised(F.col("text")).cast("binary").alias("content"))
    names = name_blocks(texts, block_bytes, hash_buckets)
    shared = not names.where(F.col("block").isNotNull()).isEmpty()

    blocks = _blocks(block_bytes, hash_buckets)
    if not shared:
        blocks = F.transform(blocks, lambda p: p["h"])
    base = written(
        texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_points", F.sha2("content", 256).alias("text_sha256"), blocks.alias("blocks")),
        "block-rows",
    )
    facts = ["rid", "doc_id", "n_points", "text_sha256"]
    pieces = base.select(*facts, F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "p"))
    if shared:
        at = pieces.select(*facts, "n", "pos", F.col("p.h").alias("h"), F.col("p.block").alias("content"))
        at = at.join(names.withColumnRenamed("block", "tie"), "h").where(F.col("tie").isNull() | (F.col("tie") == F.col("content")))
    else:
        at = pieces.withColumnRenamed("p", "h").join(names.drop("block"), "h")
    at = at.select(*facts, "n", "pos", "name")

    done = [at.where("n = 1").select(*facts, "name")]
    most = base.select(F.size("blocks").alias("n")).agg(F.max("n")).first()[0] or 1
    if most > 1:
        left = written(at.where("n > 1").select("rid", "n", "pos", "name"), "names-0")
        ends = []
        level = 0
        while most > 1:
            level += 1
            left, most = _next_level(left, level), (most + 1) // 2
            ends.append(left.where("n = 1").select("rid", "name"))
            left = left.where("n > 1")
        named = ends[0]
        for e in ends[1:]:
            named = named.unionByName(e)
        done.append(base.where(F.size("blocks") > 1).select(*facts).join(named, "rid").select(*facts, "name"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _next_level(left: DataFrame, level: int) -> DataFrame:
    """Pair adjacent names of each document and name the distinct pairs."""
    side = F.col("pos") % 2
    pairs = left.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.first("n").alias("n"),
        F.max(F.when(side == 0, F.col("name"))).alias("a"),
        # an odd last block has no right neighbour
        F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("b"),
    )
    pairs = written(pairs.withColumn("n", F.ceil(F.col("n") / 2).cast("int")), f"pairs-{level}")
    names = written(_numbered(pairs.select("a", "b").distinct(), ["a", "b"], level), f"names-{level}")
    return written(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), f"named-{level}")


def exact_dedup(docs: DataFrame, block_bytes: int = 16384, hash_buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs`` with the row that stays of its group of equal texts.

    ``docs`` has doc_id and text; other columns are ignored, whatever their
    names.  A null text counts as empty; texts of white space alone are equal
    to it.  The row with the most code points stays, then the smallest doc_id
    (null last); of fully equal rows one stays.  An empty table gives no rows.
    """
    named = written(name_documents(docs, block_bytes, hash_buckets), "named-rows")
    # the greatest of these is the row that stays
    rank = F.struct("n_points", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("id"), (-F.col("rid")).alias("rid"))
    groups = named.groupBy("name").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("name", "group_size", (-F.col("best.id")).alias("keep_id"), (-F.col("best.rid")).alias("keep_rid"))
    return named.join(groups, "name").select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "name"
    )
