"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               spread: bool = True) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; selecting ``columns`` prunes the scan.

    A parquet row group is never split, so a table of few row groups would be
    scanned (and all per-row work after it run) by a few tasks.  With ``spread``
    such an input, if it is estimated to hold at least ``SPREAD_BYTES_PER_TASK``
    per core, is dealt round-robin to ``defaultParallelism`` partitions; small
    tables stay one task, and an input of many splits, as at scale, is left
    alone and costs no shuffle.  Sides that a join broadcasts pass ``spread=False``.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    if spread:
        target = spark.sparkContext.defaultParallelism
        if target > 1 and df.rdd.getNumPartitions() < target and estimated_bytes(df) >= target * SPREAD_BYTES_PER_TASK:
            df = df.repartition(target)
    return df


# Below this many input bytes per core a single scan task is cheaper than a shuffle.
SPREAD_BYTES_PER_TASK = 512 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; of a scan, its files' bytes scaled to the selected columns."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
