"""A filter of fixed size before a join, so that rows without a partner are not shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 2,048 rows of 4 KB are all that is sent to workers, however many keys are wanted
BITS = 26


def likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` whose ``keys`` may be among those of ``wanted``: none that is gets lost, few others stay.

    Null is a key like any other.  The bitmap is of one size for any number of
    keys; where there are too many for it, more rows stay for the join that
    follows.  Columns may have any names but slice, bit, map and map_slice.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << BITS))
    place = [F.shiftright(bit, 15).alias("slice"), bit.bitwiseAND(32767).alias("bit")]
    maps = wanted.select(*place).groupBy("slice").agg(F.bitmap_construct_agg("bit").alias("map"))
    byte = F.conv(F.hex(F.substring("map", F.shiftright("bit", 3).cast("int") + 1, 1)), 16, 10).cast("long")
    test = F.getbit(byte, F.col("bit").bitwiseAND(7).cast("int")) == 1
    placed = rows.select("*", *place)
    return placed.join(F.broadcast(maps.withColumnRenamed("slice", "map_slice")), (F.col("slice") == F.col("map_slice")) & test).select(*rows.columns)
