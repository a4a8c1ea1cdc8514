"""Mixing sources to target weights by Pfair scheduling of blocks.

The rows of each source are dealt into blocks.  While the sources W are left,
source s gets w_s / sum(W) of the slots; a source whose blocks are used up goes
and the weights of the others are taken anew, so every block has a slot.  At that
steady rate block j of a source would begin at F(j) and end at F(j + 1): it is
released at slot floor(F(j)) and due at slot ceil(F(j + 1)), and of the released
blocks the one that is due first takes the next slot.  All blocks meet their
windows, so that after any number of slots each source has its share within less
than one block.

Weights are exact fractions (of their decimal digits) and windows are whole
numbers, so a source may have any share.  The schedule needs the number of blocks
of each source only; the driver makes it in one pass and writes it in slices, a
row for each block, so that what it holds does not grow.  Rows are numbered in
salted groups with running sums over the group counts, so that one source may hold
most rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tourlog.llm.storage import shared_folder, written

# groups in which the rows of a source are numbered
SALTS = 4096
MAX_SOURCES = 10_000
# blocks of the schedule that the driver holds
SLICE = 1 << 20


def tempered_weights(docs: DataFrame, source: str = "source", alpha: float = 0.7) -> DataFrame:
    """Weights by the number of rows of a source to the power ``alpha``: (source, weight)."""
    counts = docs.groupBy(F.col(source).alias("source")).count()
    return counts.select("source", F.pow(F.col("count").cast("double"), F.lit(alpha)).alias("weight"))


def _whole(weights: list) -> list[int]:
    """Whole numbers in the ratio of the weights as written in decimal."""
    exact = [Fraction(str(w)) for w in weights]
    scale = math.lcm(*[x.denominator for x in exact])
    whole = [int(x * scale) for x in exact]
    common = math.gcd(*whole)
    return [x // common for x in whole]


def _phases(weights: list[int], blocks: list[int]) -> list[tuple[int, int, int, int]]:
    """Stretches of slots with the same sources: (used, rate, n, w).

    At the time v at which a source of weight w has had w * v blocks, used +
    rate * v slots have gone.  The stretch ends at v = n / w, where its first
    source runs out.
    """
    order = sorted(range(len(weights)), key=lambda s: Fraction(blocks[s], weights[s]))
    out, used, rate = [], 0, sum(weights)
    for s in order:
        out.append((used, rate, blocks[s], weights[s]))
        used, rate = used + blocks[s], rate - weights[s]
    return out


def schedule(weights: list[int], blocks: list[int]) -> Iterator[int]:
    """The number of the source that has each slot, for all blocks of all sources."""
    phases = _phases(weights, blocks)
    count, phase = len(weights), [0] * len(weights)

    def begin(s: int, j: int) -> tuple[int, int]:
        """F(j) of source s as a fraction, for j that do not fall."""
        w, p = weights[s], phase[s]
        while p + 1 < count and j * phases[p][3] > phases[p][2] * w:
            p += 1
        phase[s] = p
        used, rate = phases[p][:2]
        return used * w + rate * j, w

    done = [0] * count
    release = [(0, s) for s in range(count) if blocks[s]]
    ready: list[tuple[int, int]] = []
    for slot in range(sum(blocks)):
        while release and release[0][0] <= slot:
            s = heapq.heappop(release)[1]
            top, under = begin(s, done[s] + 1)
            heapq.heappush(ready, (-(-top // under), s))
        s = heapq.heappop(ready)[1]
        yield s
        done[s] += 1
        if done[s] < blocks[s]:
            top, under = begin(s, done[s])
            heapq.heappush(release, (top // under, s))


def _write_schedule(spark: SparkSession, weights: list[int], blocks: list[int]) -> DataFrame:
    """The table (mix_source, mix_block, mix_slot), written slice by slice."""
    import pyarrow as pa

    path = shared_folder(spark, "mix-schedule")
    done, slots, first = np.zeros(len(weights), np.int64), schedule(weights, blocks), 0
    while True:
        sources = np.fromiter((s for _, s in zip(range(SLICE), slots)), np.int32)
        block = np.empty(len(sources), np.int64)
        order = np.argsort(sources, kind="stable")
        counts = np.bincount(sources, minlength=len(done))
        starts = np.cumsum(counts) - counts
        block[order] = np.arange(len(order)) - np.repeat(starts, counts) + np.repeat(done, counts)
        table = pa.table({"mix_source": sources, "mix_block": block, "mix_slot": np.arange(first, first + len(sources), dtype=np.int64)})
        spark.createDataFrame(table, "mix_source int, mix_block long, mix_slot long").write.mode("append").parquet(path)
        done, first = done + counts, first + len(sources)
        if first >= sum(blocks):
            return spark.read.schema("mix_source int, mix_block long, mix_slot long").parquet(path)


def mix(docs: DataFrame, weights: DataFrame, source: str = "source", block_rows: int = 32, period: int = 1000, seed: int = 11) -> DataFrame:
    """``docs`` in a mixed order: their columns and ``mix_block``, ``mix_slot``, ``mix_at``, ``in_mix``.

    Rows of a source come in a seeded order, in blocks of ``block_rows`` (the
    last may be shorter); mix_slot is the place of the block, mix_at the place
    of the row in it.  Every row of a source with a weight has a slot: where a
    source runs out, the others go on in the ratio of their weights.  ``in_mix``
    marks the slots in which every source has blocks left.  A null source is a
    source; rows of a source without weight have no slot and are not in the mix.
    ``period`` has no effect, as weights are not rounded.  Columns of the input
    must not have the names added.
    """
    spark, names = docs.sparkSession, docs.columns
    salt = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    rows = written(docs.select("*", salt.alias("mix_salt"), F.monotonically_increasing_id().alias("mix_rid")), "mix-rows")

    # rows before each salted group: a running sum over at most SALTS counts of a source
    counts = rows.groupBy(F.col(source).alias("src"), "mix_salt").count()
    running = Window.partitionBy("src").orderBy("mix_salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = written(counts.select("src", F.col("mix_salt").alias("salt"), (F.sum("count").over(running) - F.col("count")).alias("first"), F.col("count").alias("n")), "mix-firsts")

    weights = weights.where("weight > 0").groupBy(F.col("source").alias("of_source")).agg(F.sum("weight").alias("weight"))
    if weights.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = firsts.groupBy("src").agg(F.ceil(F.sum("n") / block_rows).alias("blocks"))
    known = sizes.join(weights, F.col("src").eqNullSafe(F.col("of_source"))).select("src", "blocks", "weight").collect()
    known.sort(key=lambda r: (r.src is not None, r.src if r.src is not None else 0))
    whole, blocks = _whole([r.weight for r in known]), [r.blocks for r in known]
    end = min((sum(whole) * n // w for n, w in zip(blocks, whole)), default=0)
    numbers = spark.createDataFrame([(r.src, k) for k, r in enumerate(known)], f"of_source {rows.schema[source].dataType.simpleString()}, mix_source int")
    slots = _write_schedule(spark, whole, blocks)

    firsts = firsts.join(F.broadcast(numbers), F.col("src").eqNullSafe(F.col("of_source")), "left").drop("of_source", "n")
    # places are found without the texts, which then meet them once
    place = Window.partitionBy(source, "mix_salt").orderBy(F.xxhash64(F.lit(seed), "mix_rid"), "mix_rid")
    at = rows.select(source, "mix_salt", "mix_rid", F.row_number().over(place).alias("mix_row"))
    at = at.join(firsts, at[source].eqNullSafe(firsts["src"]) & (at["mix_salt"] == firsts["salt"]))
    at = at.withColumn("mix_row", F.col("first") + F.col("mix_row") - 1)
    at = at.withColumns({"mix_block": F.floor(F.col("mix_row") / block_rows), "mix_at": (F.col("mix_row") % block_rows).cast("int")})
    at = at.join(slots, ["mix_source", "mix_block"], "left").select("mix_rid", "mix_block", "mix_slot", "mix_at")
    out = rows.join(at, "mix_rid")
    return out.select(*names, "mix_block", "mix_slot", "mix_at", F.coalesce(F.col("mix_slot") < F.lit(end).cast("long"), F.lit(False)).alias("in_mix"))
