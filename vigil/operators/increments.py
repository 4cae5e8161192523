"""S2 with A1-A3 kept up to date: new or changed runs are merged without reading the others again.

The state is a Parquet table of mergeable sums, one row per cell of a (run, model)
folder: number of rows, of positive answers, and sum and count of each value column.
It is partitioned by run and model, and every row carries the fingerprint of the folder
that it was made from, so the state is its own manifest: a folder whose files have
another fingerprint is read again and replaces its partition, and a folder that is gone
is passed over when the state is read.

Fingerprints are order-independent sums of hashes over (name, length, time) of the data
files, listed by Spark's file source; no data is read for them.  The names of the folders
to be read go to the driver, as every path that Spark reads does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.numeric import is_yes, nan_to_null, round_half_even
from vigil.functions.text import strip_run_suffix
from vigil.operators.rates import DEFAULT_CORNERS, MORAL4
from vigil.session import materialize
from vigil.sources.responses import path_exists, scan_all_runs

CELL = ("closeness_level", "closeness_level_name", "severity_level")
RUN, MODEL = "perspective_run", "model"


def folder_fingerprints(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """(perspective_run, model, fingerprint) of the folders ``root/perspective_run=<run>/model=<model>``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", "true").load(root.rstrip("/"))
    part = lambda name: F.url_decode(F.regexp_replace(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), r"\+", "%2B"))
    named = files.select(part(RUN).alias(RUN), part(MODEL).alias(MODEL),
                         F.xxhash64(F.regexp_extract("path", "([^/]*)$", 1), "length", "modificationTime").alias("h"))
    # decimals hold the sum of any number of 64-bit hashes
    total = F.sum(F.col("h").cast("decimal(38,0)"))
    return named.groupBy(RUN, MODEL).agg(F.concat_ws("-", F.count(F.lit(1)), total).alias("fingerprint"))


def cell_sums(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str], answer: str = "answer", positive: str = "Yes") -> DataFrame:
    """Mergeable sums of a scored table by ``keys``: n, n_yes, and ``<c>__sum``, ``<c>__n`` of each value column."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(is_yes(answer, positive)).cast("long").alias("n_yes")]
    for c in value_cols:
        v = nan_to_null(c)
        aggs += [F.sum(v).cast("double").alias(f"{c}__sum"), F.count(v).alias(f"{c}__n")]
    return df.groupBy(*keys).agg(*aggs)


def update_state(spark: SparkSession, root: str, state: str, prepare: Callable[[DataFrame], DataFrame],
                 value_cols: Sequence[str] = MORAL4, fmt: str = "parquet", schema=None) -> list[tuple[str, str]]:
    """Brings the state of the runs under ``root`` up to date; returns the (run, model) folders that were read.

    ``prepare`` makes scored rows (answer, levels, value columns) of scanned ones and keeps run and model.
    """
    now = materialize(folder_fingerprints(spark, root, fmt))
    known = _state(spark, state).select(RUN, MODEL, "fingerprint").distinct() if path_exists(spark, state) else now.limit(0)
    todo = sorted((r[RUN], r[MODEL]) for r in now.join(known, [RUN, MODEL, "fingerprint"], "left_anti").collect())
    if not todo:
        return []
    # a filter on partition columns: only these folders are listed for the scan and read
    wanted = spark.createDataFrame(todo, f"{RUN} string, {MODEL} string")
    rows = scan_all_runs(spark, root, fmt=fmt, schema=schema)
    rows = rows.where(F.col(RUN).isin(sorted({r for r, _ in todo})) & F.col(MODEL).isin(sorted({m for _, m in todo})))
    rows = rows.join(F.broadcast(wanted), [RUN, MODEL], "left_semi")
    sums = cell_sums(prepare(rows), [RUN, MODEL, *CELL], value_cols)
    # a folder without a row that counts keeps a mark, so that it is not read again
    folders = now.join(F.broadcast(wanted), [RUN, MODEL])
    out = folders.join(sums, [RUN, MODEL], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_yes": F.coalesce("n_yes", F.lit(0))})
    out.repartition(RUN, MODEL).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN, MODEL).parquet(state)
    return todo


def _state(spark: SparkSession, state: str) -> DataFrame:
    from pyspark.sql.types import StringType, StructField, StructType

    kind = spark.read.parquet(state).schema
    kind = StructType([f for f in kind.fields if f.name not in (RUN, MODEL)] + [StructField(c, StringType()) for c in (RUN, MODEL)])
    return spark.read.schema(kind).parquet(state)


def read_state(spark: SparkSession, root: str, state: str, fmt: str = "parquet") -> DataFrame:
    """The state's cells of folders that are still there as they were read."""
    return _state(spark, state).join(folder_fingerprints(spark, root, fmt), [RUN, MODEL, "fingerprint"], "left_semi").where("n > 0")


def _perspective(combine_runs: bool) -> Column:
    return (strip_run_suffix(F.col(RUN)) if combine_runs else F.col(RUN)).alias("perspective")


def stats_from_state(cells: DataFrame, combine_runs: bool = True, expected_rows: int = 1296,
                     corner_cells: Sequence[tuple[int, int]] = DEFAULT_CORNERS, digits: int = 3) -> DataFrame:
    """A1/A2 from the sums: the columns of ``stats_by_model_perspective``."""
    n, yes = F.sum("n"), F.sum("n_yes")
    aggs = [round_half_even(n / F.lit(float(expected_rows)), digits).alias("response_rate"),
            round_half_even(yes / n, digits).alias("overall_yes_ratio")]
    for a, b in corner_cells:
        cell = (F.col("closeness_level") == a) & (F.col("severity_level") == b)
        share = F.sum(F.when(cell, F.col("n_yes"))) / F.sum(F.when(cell, F.col("n")))
        aggs.append(round_half_even(share, digits).alias(f"closeness{a}_severity{b}_yes_ratio"))
    return cells.withColumn("perspective", _perspective(combine_runs)).groupBy(MODEL, "perspective").agg(*aggs)


def report_from_state(cells: DataFrame, value_cols: Sequence[str] = MORAL4, combine_runs: bool = True) -> DataFrame:
    """A3 from the sums: the columns of ``report_ratio``; null levels are left out."""
    keys = [*CELL, MODEL, "perspective"]
    d = cells.withColumn("perspective", _perspective(combine_runs)).dropna(subset=keys)
    mean = lambda c: F.try_divide(F.sum(f"{c}__sum"), F.sum(f"{c}__n")).alias(c)
    return d.groupBy(*keys).agg((F.sum("n_yes") / F.sum("n")).alias("report_ratio"), *[mean(c) for c in value_cols])
