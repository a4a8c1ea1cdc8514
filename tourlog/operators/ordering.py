"""Row numbers and neighbours inside groups of any size.

A plain window over ``partitionBy(key)`` sorts a whole key in one task; when
one key holds a third of the table that task never ends.  Here a large key is cut
into slices by leading sort expressions: only slices are sorted, and the small
table of slice sizes gives each slice the number of rows before it.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# rows of a key that one task sorts
LARGE = 100_000


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, where null equals null, so that no row is lost."""
    named = right.select(*[F.col(c).alias(f"_on_{c}" if c in keys else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in keys]
    out = left.join(named, functools.reduce(lambda a, b: a & b, same))
    return out.drop(*[f"_on_{c}" for c in keys])


def number_rows(
    df: DataFrame, keys: list[str], slices: list[str], order: list[str | Column], name: str = "row_no"
) -> DataFrame:
    """1-based dense number of each row in its key, by ``order``.

    ``slices`` must rise with ``order`` (equal or coarser leading
    expressions), so that all rows of a lower slice sort before a higher one.
    A key of at most ``LARGE`` rows is sorted as a whole, so its rows move once;
    only the rows of larger keys are numbered by slices.  The list of large
    keys has at most a row for every ``LARGE`` rows and goes to all tasks.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > LARGE).select(*[F.col(c).alias(f"_on_{c}") for c in keys], F.lit(True).alias("_large"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in keys])
    # an outer join stays above the shuffles of ``df``, so that they are made once for both parts
    marked = df.join(F.broadcast(large), same, "left")
    small = marked.filter("_large is null").select(*df.columns)
    small = small.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return small.unionByName(_number_slices(marked.filter("_large").select(*df.columns), keys, slices, order, name))


def _number_slices(df: DataFrame, keys: list[str], slices: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Rows move by (keys, slices); only slice counts move by key."""
    grain = [*keys, *slices]
    sizes = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(*slices).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*grain, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*grain).orderBy(*order)
    return (
        join_on(df, offsets, grain)
        .withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("int"))
        .drop("_before")
    )


def neighbours(
    df: DataFrame, keys: list[str], number: str, values: dict[str, tuple[str, int]]
) -> DataFrame:
    """Add columns taken from the row ``step`` places away.

    Dense row numbers turn lag and lead into equi-joins on (key, number), which
    spread a large key over all tasks.  ``values`` maps an output name to
    (input column, step).
    """
    out = df
    for step in sorted({s for _, s in values.values()}):
        wanted = {new: col for new, (col, s) in values.items() if s == step}
        other = df.select(
            *keys, (F.col(number) - F.lit(step)).alias(number), *[F.col(c).alias(n) for n, c in wanted.items()]
        )
        out = out.join(other, [*keys, number], "left")
    return out


def first_by(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each key: a partial aggregate, not a sort of the key."""
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    ).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns if c not in keys])


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    The bound on the row number lets Spark drop all but ``k`` rows per key in
    every map task (WindowGroupLimit) before the shuffle.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def carry_forward(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = 4096, ties: list[str] | None = None
) -> DataFrame:
    """Latest non-null ``value`` at or before each row, by a numeric ``order``.

    Rows are handled in blocks of the order axis; the last value of each block
    is handed to the next one through a table with one row per block, so a
    long key is shared by many tasks.
    """
    rows = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / block))
    grain = [*keys, "_block"]
    sort = [order, *(ties or [])]
    ends = rows.groupBy(*grain).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*sort))).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.select(*grain, F.last("_end", ignorenulls=True).over(earlier).alias("_value"), F.lit(0).alias("_lead")).filter("_value is not null")
    # the value from before stands as a row ahead of its block, so rows move once
    led = rows.withColumn("_lead", F.lit(1)).unionByName(handed, allowMissingColumns=True)
    inside = W.partitionBy(*grain).orderBy("_lead", *sort).rowsBetween(W.unboundedPreceding, 0)
    valued = led.withColumn(name, F.last("_value", ignorenulls=True).over(inside)).filter("_lead = 1")
    return valued.select(*df.columns, name)
