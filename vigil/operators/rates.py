"""Grouped rates, means and medians.

All are single ``groupBy`` aggregates with map-side partial aggregation, so
a hot group costs one partial row per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.numeric import is_yes, nan_to_null, round_half_even
from vigil.functions.text import strip_run_suffix
from vigil.session import materialize

DEFAULT_CORNERS = ((1, 4), (4, 1))


def yes_ratios(df: DataFrame, keys: Sequence[str] = (), expected_rows: int = 1296,
               corner_cells: Sequence[tuple[int, int]] = DEFAULT_CORNERS,
               answer: str = "answer", positive: str = "Yes",
               row_level: str = "closeness_level", col_level: str = "severity_level",
               digits: int = 3) -> DataFrame:
    """A1: response rate (rows / expected), share of ``positive`` over all rows,
    and the same share inside each corner cell (NULL when the cell is empty)."""
    y = is_yes(answer, positive)
    aggs = [round_half_even(F.count(F.lit(1)) / F.lit(float(expected_rows)), digits).alias("response_rate"),
            round_half_even(F.avg(y), digits).alias("overall_yes_ratio")]
    for a, b in corner_cells:
        cell = (F.col(row_level) == a) & (F.col(col_level) == b)
        aggs.append(round_half_even(F.avg(F.when(cell, y)), digits)
                    .alias(f"closeness{a}_severity{b}_yes_ratio"))
    keys = list(keys)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def stats_by_model_perspective(df: DataFrame, combine_runs: bool = True, expected_rows: int = 1296,
                               model: str = "model", run: str = "perspective_run", **kw) -> DataFrame:
    """A2: A1 per (model, perspective); runs pooled when ``combine_runs``.
    Groups without rows do not appear; rows with a NULL key are dropped."""
    persp = strip_run_suffix(F.col(run)) if combine_runs else F.col(run)
    d = df.withColumn("perspective", persp).where(F.col(model).isNotNull() & F.col("perspective").isNotNull())
    out = yes_ratios(d, keys=[model, "perspective"], expected_rows=expected_rows, **kw)
    return out.select(model, "perspective", *[c for c in out.columns if c not in (model, "perspective")])


REPORT_KEYS = ("closeness_level", "closeness_level_name", "severity_level", "model", "perspective")
MORAL4 = ("care_ratio", "fairness_ratio", "loyalty_ratio", "authority_ratio")


def report_ratio(df: DataFrame, keys: Sequence[str] = REPORT_KEYS, value_cols: Sequence[str] = MORAL4,
                 answer: str = "answer", positive: str = "Yes") -> DataFrame:
    """A3: mean of the 0/1 report indicator and of ``value_cols`` per key tuple.
    NULL keys are dropped (pandas groupby); NaN values are skipped."""
    keys = list(keys)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    aggs = [F.avg(is_yes(answer, positive)).alias("report_ratio")]
    aggs += [F.avg(nan_to_null(c)).alias(c) for c in value_cols]
    return df.where(cond).groupBy(*keys).agg(*aggs)


def profile_means(df: DataFrame, keys: Sequence[str] = ("model", "perspective"),
                  value_cols: Sequence[str] = MORAL4, long: bool = False) -> DataFrame:
    """A4: mean of each value column per group; ``long`` unpivots to (metric, value)."""
    keys = list(keys)
    wide = df.groupBy(*keys).agg(*[F.avg(nan_to_null(c)).alias(c) for c in value_cols])
    if not long:
        return wide
    return wide.unpivot(keys, list(value_cols), "metric", "value")


def group_median(df: DataFrame, keys: Sequence[str] = ("model", "perspective"),
                 col: str = "report_ratio", out: str = "median", method: str = "sorted",
                 accuracy: int = 100_000) -> DataFrame:
    """A5: median per group (linear interpolation), NULL/NaN skipped, empty
    groups absent, rows with a NULL key dropped.

    ``sorted`` (default) is exact at every size and never holds a group in one
    task: equal values of a group collapse to one row with their count (map-side
    combined), a range-partitioned sort orders (keys, value), and the counts
    before a row are those of its group in earlier partitions plus those before
    it in its own.  ``exact`` is Spark's ``percentile`` (keeps a group's distinct
    values in one task: fine for report-sized inputs).  ``approx`` is
    ``percentile_approx``.
    """
    keys = list(keys)
    v = nan_to_null(col)
    d = df.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull())
    if method == "exact":
        return d.groupBy(*keys).agg(F.percentile("__v", F.lit(0.5)).cast("double").alias(out))
    if method == "approx":
        return d.groupBy(*keys).agg(F.percentile_approx("__v", 0.5, accuracy).cast("double").alias(out))
    if method != "sorted":
        raise ValueError(f"unknown method {method!r}")
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    c = d.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # written once, so the partition numbers hold for both uses below
    c = materialize(c.orderBy(*keys, "__v").withColumn("__p", F.spark_partition_id()))
    parts = c.groupBy(*keys, "__p").agg(F.sum("__c").alias("__in"))
    earlier = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "__p", F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__off"),
                         F.sum("__in").over(Window.partitionBy(*keys)).alias("__n"))
    before = Window.partitionBy("__p", *keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    # AQE broadcasts the (partition, group) sums if their actual size allows
    r = c.withColumn("__upto", F.sum("__c").over(before)).join(parts, [*keys, "__p"])
    first = F.col("__off") + F.col("__upto") - F.col("__c")  # 0-based rank of the value's first row
    last = F.col("__off") + F.col("__upto") - 1

    def at(rank):
        return F.max(F.when(rank.between(first, last), F.col("__v")))

    lower = F.floor((F.col("__n") - 1) / 2)
    upper = F.ceil((F.col("__n") - 1) / 2)
    return r.groupBy(*keys).agg(((at(lower) + at(upper)) / 2.0).alias(out))


def model_order(stats: DataFrame, metric: str = "overall_yes_ratio", first: str | None = None,
                model: str = "model", perspective: str = "perspective") -> DataFrame:
    """A10/O1: rank models by ``metric`` in perspective ``first`` (descending),
    or by the mean over perspectives when ``first`` is None; ties by name."""
    if first is not None:
        base = stats.where(F.col(perspective) == first).groupBy(model).agg(F.avg(metric).alias("score"))
    else:
        base = stats.groupBy(model).agg(F.avg(nan_to_null(metric)).alias("score"))
    from vigil.operators.report import global_row_number
    return global_row_number(base.select(model, "score"), [F.col("score").desc_nulls_last(), F.col(model)], "rank")


def level_names(df: DataFrame, level: str = "closeness_level", name: str = "closeness_level_name",
                order: str | None = None) -> DataFrame:
    """One name per level (first by ``order``, else the smallest name); NULLs removed."""
    d = df.where(F.col(level).isNotNull() & F.col(name).isNotNull())
    pick = F.min_by(name, order) if order else F.min(name)
    return d.groupBy(level).agg(pick.alias(name))


def sorted_keys(df: DataFrame, key: str) -> DataFrame:
    """O2: distinct non-null keys in ascending order."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)
