"""Session and scratch-table helpers shared by the batch and streaming jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tourlog", cores: str = "8", memory: str = "8g") -> SparkSession:
    """Session used by the tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # wide projections compile to methods above the size HotSpot compiles by default
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only where the session names none (tests on
    one machine); on a cluster every executor must see the path.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return f"{root.rstrip('/')}/tourlog-{purpose}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_end(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it has run, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a shared table and read it back, cutting the lineage.

    Unlike a cache in executor memory the files survive the loss of executors,
    and every reader sees the same rows.
    """
    path = shared_dir(df.sparkSession, purpose)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, pieces: int = 1) -> DataFrame:
    """Share a few unsplittable files among all cores before text-heavy work.

    Input that already comes in at least as many partitions as there are cores
    (any large table) is left alone, unless each of its partitions is to be cut
    into ``pieces``: where work on a row takes far longer than reading it, the
    longest task then stays short whatever the size of the input.
    """
    cores, given = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if given >= cores and pieces == 1 else df.repartition(max(cores, given * pieces))
