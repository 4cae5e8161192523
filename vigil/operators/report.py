"""Report shaping: pivots, skeletons, clusters, ordering, unions (A7-A9,
A14, A16, J5, J6, O3, K1, U1)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans.sizing import row_counts



def _levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.select(*cols).where(cond).distinct()


def dense_skeleton(values: DataFrame, level_sets: Sequence[DataFrame | Sequence[str]],
                   source: DataFrame | None = None, fill: Mapping | None = None,
                   materialize: bool = False, max_rows: int | None = None) -> DataFrame:
    """Left-join ``values`` onto the product of key level sets (``reindex``).

    Each level set is a small DataFrame of keys, or column names whose distinct
    values are taken from ``source`` (default: ``values``).  Level sets are
    counted before they are broadcast; the product is the dense output itself,
    limited only if the caller sets ``max_rows``.  ``materialize`` checkpoints a small ``values`` table first, so that
    deriving level sets from it does not re-run the plan that produced it.
    """
    if materialize:
        from vigil.session import materialize as _materialize
        values = _materialize(values)
    source = values if source is None else source
    levels = [ls if isinstance(ls, DataFrame) else _levels(source, list(ls)) for ls in level_sets]
    counts = row_counts(levels)  # one job for all level sets
    size = 1
    for n in counts:
        size *= max(n, 1)
    if max_rows is not None and size > max_rows:
        raise ValueError(f"dense skeleton of {size} rows exceeds max_rows={max_rows}")
    from vigil.operators.grid import cross_product
    skel = cross_product(levels, counts)
    keys = [c for lv in levels for c in lv.columns]
    # Level tables may carry attributes (labels, positions); join on the
    # columns the values share with the skeleton.
    on = [c for c in keys if c in values.columns]
    out = skel.join(values, on=on, how="left")
    return out.fillna(dict(fill)) if fill else out


def pivot_matrix(df: DataFrame, page_keys: Sequence[str] = ("model", "perspective"),
                 row: str = "severity_level", col: str = "closeness_level",
                 col_values: Sequence = (1, 2, 3, 4), value: str = "report_ratio",
                 prefix: str = "c") -> DataFrame:
    """Per page, rows = observed ``row`` levels (over the whole table),
    columns = the fixed ``col_values``; cell = mean of ``value``, NULL if empty."""
    page_keys = list(page_keys)
    piv = (df.where(F.col(row).isNotNull())
           .groupBy(*page_keys, row).pivot(col, list(col_values)).agg(F.avg(value)))
    piv = piv.withColumnsRenamed({str(v): f"{prefix}{v}" for v in col_values})
    # Every observed (page, row level) is a group of ``piv``: the level sets
    # come from that small table, checkpointed once, so the source is scanned
    # a single time.
    return dense_skeleton(piv, [[k] for k in page_keys] + [[row]], materialize=True)


def gap_clusters(df: DataFrame, keys: Sequence[str] = ("model",), value: str = "median",
                 member: str = "perspective", tol: float = 0.035, out: str = "cluster") -> DataFrame:
    """Sort by ``value`` within ``keys``; a gap above ``tol`` to the
    previous value starts a new cluster (gaps-and-islands)."""
    w = Window.partitionBy(*keys).orderBy(F.col(value), F.col(member))
    gap = F.col(value) - F.lag(value).over(w)
    new = F.when(gap.isNull() | (gap <= F.lit(tol)), F.lit(0)).otherwise(F.lit(1))
    d = df.withColumn("__new", new)
    return d.withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")) \
        .drop("__new")


def cluster_anchor(df: DataFrame, keys: Sequence[str] = ("model",), cluster: str = "cluster",
                   value: str = "median", member: str = "perspective",
                   priority: Mapping[str, int] | None = None, unknown: int = 999) -> DataFrame:
    """Cluster size, cluster mean and member rank (by priority, unknown last)."""
    pr = F.lit(unknown)
    if priority:
        m = F.create_map(*[x for kv in priority.items() for x in (F.lit(kv[0]), F.lit(int(kv[1])))])
        pr = F.coalesce(F.try_element_at(m, F.col(member)), F.lit(unknown))
    part = Window.partitionBy(*keys, cluster)
    d = df.withColumn("priority", pr)
    return d.withColumns({
        "cluster_size": F.count(F.lit(1)).over(part),
        "cluster_mean": F.avg(value).over(part),
        "member_rank": F.row_number().over(part.orderBy("priority", member)),
    })


def explicit_order(df: DataFrame, key: str, order: Sequence, out: str = "order_pos") -> DataFrame:
    """O3: 1-based position of ``key`` in ``order`` (NULL when absent), sorted by it."""
    arr = F.array(*[F.lit(v) for v in order])
    pos = F.array_position(arr, F.col(key))
    return df.withColumn(out, F.when(pos > 0, pos.cast("int"))).orderBy(F.col(out).asc_nulls_last(), key)


def membership(df: DataFrame, key: str, order: Sequence, out: str = "order_pos") -> DataFrame:
    """The ordered list restricted to values present in ``df[key]``."""
    spark = df.sparkSession
    lst = spark.createDataFrame([(v, i + 1) for i, v in enumerate(order)], f"{key} string, {out} int")
    # distinct first: map-side partial aggregation leaves one row per key and
    # task, so a hot key is never shuffled row by row
    return lst.join(df.select(key).distinct(), key, "left_semi").orderBy(out)


def global_row_number(df: DataFrame, order: Sequence, out: str = "rank") -> DataFrame:
    """1-based position of every row under a total ``order`` (break ties in
    it), without a window that pulls all rows into one task.

    A range-partitioned sort tags rows with ``monotonically_increasing_id``
    (partition index in the high bits, position inside the partition in the
    low 33 bits); the tagged table is checkpointed so the tags survive
    recomputation.  Per-partition counts (one row per partition) become
    offsets that are broadcast back.
    """
    from vigil.session import materialize

    s = materialize(df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()))
    s = s.withColumns({"__pid": F.shiftright("__mid", 33),
                       "__idx": F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sorted table: a bounded broadcast
    offs = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c")) \
        .select("__pid", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    pos = (F.col("__off") + F.col("__idx") + F.lit(1)).cast("long").alias(out)
    return s.join(F.broadcast(offs), "__pid", "inner") \
        .select(*[F.col(c) for c in df.columns], pos)


def head_n(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """K1: first ``n`` rows under an explicit total order (a top-k)."""
    return df.orderBy(*order).limit(n)


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Append frames by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def axis_limits(summary: DataFrame, low: str = "ci95_low", high: str = "ci95_high",
                pad: float = 0.03) -> DataFrame:
    """``max(0, min(low) - pad)`` and ``min(1, max(high) + pad)``."""
    return summary.agg(F.greatest(F.lit(0.0), F.min(low) - F.lit(pad)).alias("y_min"),
                       F.least(F.lit(1.0), F.max(high) + F.lit(pad)).alias("y_max"))


def error_bars(summary: DataFrame, keys: Sequence[str] = ("perspective", "metric"),
               answer: str = "answer", center: str = "mean", low: str = "ci95_low",
               high: str = "ci95_high", levels: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """(centre - low, high - centre) per answer level, aligned by metric."""
    aggs = []
    for lv in levels:
        cond = F.col(answer) == F.lit(lv)
        tag = lv.lower()
        aggs += [F.max(F.when(cond, F.col(center))).alias(f"{tag}_{center}"),
                 F.max(F.when(cond, F.col(center) - F.col(low))).alias(f"{tag}_err_low"),
                 F.max(F.when(cond, F.col(high) - F.col(center))).alias(f"{tag}_err_high")]
    return summary.groupBy(*keys).agg(*aggs)
