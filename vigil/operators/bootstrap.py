"""Grouped percentile bootstrap intervals.

Poisson(1) bootstrap: replicate ``b`` gives each row a weight drawn from
(seed, row key, b) only, so results do not depend on partitioning, batch
boundaries or task retries.

Default engine (``mix32``): a 32-bit row seed is computed in Spark (md5 of
seed and key); inside each Arrow batch numpy draws the (rows x replicates)
weight matrix chunk by chunk and folds it into per-(group, replicate) partial
sums with one matrix product.  Sums are kept over all batches of a task (and
flushed when it holds many groups), so groups x replicates partial rows per
task are shuffled, however many rows it read; Spark sums them per (group, replicate), and the interval
is the linear-interpolation percentile of the replicate statistics
(``np.percentile``).

The median is exact without holding a group in one task: every replicate
median lies, with overwhelming probability, inside a bracket of ranks
n/2 +- 5 sqrt(n) around the plain median (its rank spread is about
sqrt(n)/2); approximate quantiles give that bracket.  Weights below it are
summed per task like the mean, and only the rows inside it are shipped, to
blocks of replicates, where numpy picks the weighted order statistics.  Equal
values inside it are shipped as one row with their summed replicate weights
once there are more of them than replicates, so a bracket that holds a value
with very many ties (zero, say) stays small.  A
replicate median outside its bracket raises instead of returning a wrong
value.

The JVM-only engines (``xxhash64``, ``md5``) fan rows out to replicates with
``explode`` and rely on map-side partial aggregation; slower, no Python.

Point estimates are the plain statistic on the non-null values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from vigil.functions.hashing import mix32_words, poisson1_from_words, poisson1_weight, row_seed, unit_hash
from vigil.functions.numeric import nan_to_null
from vigil.operators.report import dense_skeleton

CHUNK_ROWS = 2048
HELD_GROUPS = 500  # groups whose sums a task keeps (51 kB each for 800 replicates of four columns)


def _names(ci: int) -> tuple[str, str]:
    return f"ci{ci}_low", f"ci{ci}_high"


def _mean_partials(d: DataFrame, keys: list[str], cols: list[str], n_boot: int) -> DataFrame:
    """(keys, __b, __s_i, __w_i) partial sums per batch and group."""
    key_fields = [d.schema[k] for k in keys]
    schema = StructType(key_fields + [StructField("__b", IntegerType(), False)]
                        + [StructField(f"__s_{i}", DoubleType(), False) for i in range(len(cols))]
                        + [StructField(f"__w_{i}", DoubleType(), False) for i in range(len(cols))])
    bs = np.arange(n_boot, dtype=np.uint32)

    def rows(sums: dict):
        # replicate -1 carries the plain sums (weight 1): the point estimate
        # comes out of the same pass, no second scan
        for kv, (plain, s, wn) in sums.items():
            out = {k: [v] * (n_boot + 1) for k, v in zip(keys, kv)}
            out["__b"] = np.arange(-1, n_boot, dtype=np.int32)
            for i in range(len(cols)):
                out[f"__s_{i}"] = np.concatenate([[plain[0, i]], s[:, i]])
                out[f"__w_{i}"] = np.concatenate([[plain[1, i]], wn[:, i]])
            yield pd.DataFrame(out)

    def run(batches):
        held: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for kv, g in groups:
                kv = kv if isinstance(kv, tuple) else (kv,)
                h = g["__h"].to_numpy(dtype=np.int64).astype(np.uint32)
                x = g[cols].to_numpy(dtype=np.float64)
                ok = ~np.isnan(x)
                x0 = np.where(ok, x, 0.0)
                s = np.zeros((n_boot, len(cols)))
                wn = np.zeros((n_boot, len(cols)))
                for a in range(0, len(g), CHUNK_ROWS):
                    w = poisson1_from_words(mix32_words(h[a:a + CHUNK_ROWS, None], bs[None, :])).astype(np.float64)
                    s += w.T @ x0[a:a + CHUNK_ROWS]
                    wn += w.T @ ok[a:a + CHUNK_ROWS].astype(np.float64)
                plain = np.stack([x0.sum(0), ok.sum(0).astype(np.float64)])
                if kv in held:
                    plain, s, wn = (a + b for a, b in zip(held[kv], (plain, s, wn)))
                held[kv] = (plain, s, wn)
            if len(held) > HELD_GROUPS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    return d.mapInPandas(run, schema)


# Half-widths (as rank fractions) of the median brackets that
# one approximate-quantile pass offers; a group takes the narrowest one that
# holds n/2 +- 5 sqrt(n) ranks plus the sketch's rank error.
BRACKET_RUNGS = (1e-6, 2e-6, 5e-6, 1e-5, 2e-5, 5e-5, 1e-4, 2e-4, 5e-4, 1e-3, 2e-3, 5e-3, 1e-2, 2e-2, 5e-2,
                 0.1, 0.2, 0.5)
MEDIAN_ACCURACY = 1_000_000
REPS_PER_TASK = 50
WORK_PER_TASK = 50_000_000  # weight draws (bracket rows x replicates) per task


def _median_bracket(d: DataFrame, keys: list[str], cols: list[str], rk: list[str], n_boot: int, seed: int,
                    qarr) -> DataFrame:
    """Wide (keys, __p_i, __n_i, __c_i) for the bootstrap median.

    Ranks around the median are bracketed; in groups under a hundred values
    that is the whole group.  Rows with a NULL key are dropped, as pandas'
    groupby does.
    """
    from vigil.plans.sizing import bounded_broadcast
    from vigil.session import materialize

    gk = [*keys, "__metric"]
    nonnull = F.lit(True)
    for k in keys:
        nonnull = nonnull & F.col(k).isNotNull()
    long = d.where(nonnull).select(*keys, row_seed(seed, *rk).alias("__h"), *cols) \
        .unpivot([*keys, "__h"], cols, "__metric", "__v")
    pct = sorted({max(0.0, 0.5 - r) for r in BRACKET_RUNGS} | {min(1.0, 0.5 + r) for r in BRACKET_RUNGS})
    st = long.groupBy(*gk).agg(F.count("__v").alias("__n"),
                               F.percentile_approx("__v", F.array(*[F.lit(p) for p in pct]),
                                                   MEDIAN_ACCURACY).alias("__q"))
    # a group without values needs no bracket
    need = F.coalesce(F.try_divide(F.lit(5.0), F.sqrt(F.col("__n").cast("double"))), F.lit(1.0)) + F.lit(3.0 / MEDIAN_ACCURACY)
    lo = hi = F.lit(None).cast("double")
    rung = F.lit(1.0)
    for r in reversed(BRACKET_RUNGS):  # the narrowest rung that is wide enough wins
        lo = F.when(need <= F.lit(r), F.col("__q")[pct.index(max(0.0, 0.5 - r))]).otherwise(lo)
        hi = F.when(need <= F.lit(r), F.col("__q")[pct.index(min(1.0, 0.5 + r))]).otherwise(hi)
        rung = F.when(need <= F.lit(r), F.lit(r)).otherwise(rung)
    # Replicate blocks per group from the work in its bracket (rows x
    # replicates): a small group is one task, a hot group's bracket is shared
    # by up to n_boot / REPS_PER_TASK tasks.
    n = F.col("__n").cast("double")
    rows_in = F.least(n, F.ceil(n * (F.lit(2.0) * rung + F.lit(2.0 / MEDIAN_ACCURACY))))
    max_blocks = max(1, -(-n_boot // REPS_PER_TASK))
    blocks = F.least(F.lit(max_blocks), F.greatest(F.lit(1), F.ceil(rows_in * F.lit(float(n_boot))
                                                                      / F.lit(WORK_PER_TASK)))).cast("int")
    st = st.select(*gk, "__n", F.coalesce(lo, F.lit(float("-inf"))).alias("__lo"),
                   F.coalesce(hi, F.lit(float("inf"))).alias("__hi"), blocks.alias("__blocks"))
    st = bounded_broadcast(materialize(st), 1_000_000)  # one row per (group, metric)
    j = long.join(st, gk, "inner")

    # Weight below each bracket and in total, per (group, metric, replicate);
    # replicate -1 has weight 1 (the plain median).
    below_ind = F.when(F.col("__v") < F.col("__lo"), F.lit(1.0)).when(F.col("__v").isNotNull(), F.lit(0.0))
    parts = _mean_partials(j.select(*gk, below_ind.alias("__x"), "__h"), gk, ["__x"], n_boot)
    # replicate b (b = -1 is the plain median) goes to block floor(b * blocks / n_boot)
    sums = parts.groupBy(*gk, "__b").agg(F.sum("__s_0").alias("__below"), F.sum("__w_0").alias("__total")) \
        .join(st.select(*gk, "__blocks"), gk, "inner") \
        .withColumn("__blk", F.floor(F.greatest(F.col("__b"), F.lit(0)) * F.col("__blocks")
                                     / F.lit(float(n_boot))).cast("int")) \
        .drop("__blocks")
    inside = j.where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
    inside = _tied_weights(inside.select(*gk, "__v", "__h", "__blocks"), gk, n_boot) \
        .select(*gk, "__v", "__h", "__c", "__w", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__blk"))

    out_schema = StructType([d.schema[k] for k in keys] + [StructField("__metric", StringType(), True),
                                                           StructField("__b", IntegerType(), False),
                                                           StructField("__r", DoubleType(), True)])

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame(columns=[f.name for f in out_schema.fields])
        left = left.sort_values("__v", kind="stable", ignore_index=True)
        v = left["__v"].to_numpy(dtype=np.float64)
        h = left["__h"].to_numpy(dtype=np.int64).astype(np.uint32)
        tied = np.flatnonzero(left["__w"].notna().to_numpy())
        summed = np.stack([np.frombuffer(x, np.uint32) for x in left["__w"].iloc[tied]]) if len(tied) else None
        count = left["__c"].to_numpy(dtype=np.float64)
        b = right["__b"].to_numpy(dtype=np.int64)
        below = right["__below"].to_numpy(dtype=np.float64)
        total = right["__total"].to_numpy(dtype=np.float64)
        res = np.full(len(b), np.nan)
        for c in range(len(b)):  # one replicate at a time: memory stays linear in the bracket
            if total[c] <= 0:
                continue  # no values in this replicate: NULL
            w = count if b[c] < 0 else poisson1_from_words(mix32_words(h, b[c:c + 1])).astype(np.float64)
            if summed is not None and b[c] >= 0:
                w[tied] = summed[:, b[c]]
            cum = np.cumsum(w, dtype=np.float64) + below[c]
            pos = (total[c] - 1.0) * 0.5
            k1, k2 = np.floor(pos), np.ceil(pos)
            i1 = int(np.searchsorted(cum, k1, side="right"))
            i2 = int(np.searchsorted(cum, k2, side="right"))
            if k1 < below[c] or i2 >= len(v):
                raise RuntimeError("bootstrap median outside its bracket; raise MEDIAN_ACCURACY")
            res[c] = v[i1] + (v[i2] - v[i1]) * (pos - k1)
        first = right.iloc[0]
        out = {k: [first[k]] * len(b) for k in gk}
        out["__b"] = b.astype(np.int32)
        out["__r"] = res
        return pd.DataFrame(out)

    med = inside.groupBy(*gk, "__blk").cogroup(sums.groupBy(*gk, "__blk")).applyInPandas(pick, out_schema)
    per_gk = med.groupBy(*gk).agg(F.max(F.when(F.col("__b") < 0, F.col("__r"))).alias("__p"),
                                  F.percentile(F.when(F.col("__b") >= 0, F.col("__r")), qarr).alias("__c"))
    per_gk = st.select(*gk, "__n").join(per_gk, gk, "left")
    aggs = []
    for i, c in enumerate(cols):
        m = F.col("__metric") == F.lit(c)
        aggs += [F.max(F.when(m, F.col("__p"))).alias(f"__p_{i}"), F.max(F.when(m, F.col("__n"))).alias(f"__n_{i}"),
                 F.max(F.when(m, F.col("__c"))).alias(f"__c_{i}")]
    return per_gk.groupBy(*keys).agg(*aggs) if keys else per_gk.agg(*aggs)


def _tied_weights(inside: DataFrame, gk: list[str], n_boot: int) -> DataFrame:
    """(gk, __v, __blocks, __h, __c, __w): rows as they are (count 1), but a value that more
    than ``n_boot`` rows of a batch share becomes one row with their count and summed weights."""
    fields = [inside.schema[k] for k in gk] + [
        StructField("__v", DoubleType(), True), StructField("__blocks", IntegerType(), True), StructField("__h", LongType(), True),
        StructField("__c", LongType(), False), StructField("__w", BinaryType(), True)]
    bs = np.arange(n_boot, dtype=np.uint32)

    def run(batches):
        for pdf in batches:
            pdf = pdf[[*gk, "__v", "__blocks", "__h"]].assign(__c=1, __w=None)
            size = pdf.groupby([*gk, "__v"], sort=False)["__c"].transform("size").to_numpy()
            yield pdf[size <= n_boot]
            for _, g in pdf[size > n_boot].groupby([*gk, "__v"], sort=False):
                h = g["__h"].to_numpy(dtype=np.int64).astype(np.uint32)
                w = np.zeros(n_boot, np.uint32)
                for a in range(0, len(h), CHUNK_ROWS):
                    w += poisson1_from_words(mix32_words(h[a:a + CHUNK_ROWS, None], bs[None, :])).sum(0, dtype=np.uint32)
                yield g.iloc[:1].assign(__c=len(g), __w=w.tobytes())

    return inside.mapInPandas(run, StructType(fields))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], cols: Sequence[str], row_key: Sequence[str] | str,
                 n_boot: int = 800, ci: int = 95, seed: int = 0, stat: str = "mean",
                 method: str = "mix32", metric: str = "metric") -> DataFrame:
    """Long result: keys, ``metric``, ``<stat>``, ``ci<ci>_low``, ``ci<ci>_high``, n.
    NULL/NaN values are removed per metric; an empty group gives NULLs, n = 0.
    Rows with a NULL key are dropped, as pandas' groupby does."""
    if stat not in ("mean", "median"):
        raise ValueError("stat must be 'mean' or 'median'")
    keys, cols = list(keys), list(cols)
    rk = [row_key] if isinstance(row_key, str) else list(row_key)
    lo, hi = _names(ci)
    q = [(100 - ci) / 200.0, 1 - (100 - ci) / 200.0]
    d = df.select(*dict.fromkeys([*keys, *rk]), *[nan_to_null(c).alias(c) for c in cols])
    for k in keys:
        d = d.where(F.col(k).isNotNull())

    stat_fn = (lambda c: F.avg(c)) if stat == "mean" else (lambda c: F.percentile(c, F.lit(0.5)))
    qarr = F.array(*[F.lit(x) for x in q])

    if method == "mix32" and stat == "mean":
        # One pass over the rows: replicate sums and (as replicate -1) the
        # plain sums that give the point estimate and n.
        dh = d.select(*keys, *cols, row_seed(seed, *rk).alias("__h"))
        part = _mean_partials(dh, keys, cols, n_boot)
        sums = part.groupBy(*keys, "__b").agg(*[F.sum(f"__s_{i}").alias(f"__s_{i}") for i in range(len(cols))],
                                             *[F.sum(f"__w_{i}").alias(f"__w_{i}") for i in range(len(cols))])
        rep = F.col("__b") >= 0
        aggs = []
        for i in range(len(cols)):
            ratio = F.try_divide(F.col(f"__s_{i}"), F.col(f"__w_{i}"))
            aggs += [F.max(F.when(~rep, ratio)).alias(f"__p_{i}"),
                     F.max(F.when(~rep, F.col(f"__w_{i}"))).cast("long").alias(f"__n_{i}"),
                     F.percentile(F.when(rep, ratio), qarr).alias(f"__c_{i}")]
        wide = sums.groupBy(*keys).agg(*aggs)
        return _long(wide, keys, cols, stat, lo, hi, metric)

    if method == "mix32":  # median: bracketed exact weighted median per (group, replicate)
        wide = _median_bracket(d, keys, cols, rk, n_boot, seed, qarr)
        return _long(wide, keys, cols, stat, lo, hi, metric)
    if method in ("xxhash64", "md5"):
        # JVM-only engines; their median keeps a (group, replicate)'s values in
        # one aggregation buffer, so use them for report-sized groups only.
        point = d.groupBy(*keys).agg(*[stat_fn(c).alias(f"__p_{i}") for i, c in enumerate(cols)],
                                     *[F.count(c).alias(f"__n_{i}") for i, c in enumerate(cols)])
        rep = d.select(*keys, *rk, *cols, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("__b"))
        rep = rep.withColumn("__w", poisson1_weight(unit_hash(seed, *rk, F.col("__b"), method=method),
                                                   kmax=18 if method == "xxhash64" else 12))
        if stat == "mean":
            aggs = [F.try_divide(F.sum(F.col("__w") * F.col(c)),
                                 F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("__w"))), F.lit(0))
                                 .cast("double")).alias(f"__r_{i}") for i, c in enumerate(cols)]
        else:
            rep = rep.where(F.col("__w") > 0)
            aggs = [F.percentile(F.col(c), F.lit(0.5), F.col("__w")).alias(f"__r_{i}") for i, c in enumerate(cols)]
        reps = rep.groupBy(*keys, "__b").agg(*aggs)
    else:
        raise ValueError(f"unknown method {method!r}")

    cis = reps.groupBy(*keys).agg(*[F.percentile(f"__r_{i}", qarr).alias(f"__c_{i}") for i in range(len(cols))])
    wide = point.join(cis, keys, "left") if keys else point.crossJoin(cis)
    return _long(wide, keys, cols, stat, lo, hi, metric)


def _long(wide: DataFrame, keys: list[str], cols: list[str], stat: str, lo: str, hi: str,
          metric: str) -> DataFrame:
    parts = [F.struct(F.lit(c).alias(metric), F.col(f"__p_{i}").cast("double").alias(stat),
                      F.col(f"__c_{i}")[0].alias(lo), F.col(f"__c_{i}")[1].alias(hi),
                      F.col(f"__n_{i}").cast("long").alias("n"))
             for i, c in enumerate(cols)]
    long = wide.select(*keys, F.explode(F.array(*parts)).alias("__t")).select(*keys, "__t.*")
    # A metric with no values in a group: statistics are NULL, n = 0.
    return long.withColumns({stat: F.when(F.col("n") > 0, F.col(stat)),
                             lo: F.when(F.col("n") > 0, F.col(lo)), hi: F.when(F.col("n") > 0, F.col(hi))})


def default_metric_names(cols: Sequence[str]) -> dict[str, str]:
    """``care_ratio`` -> ``Care`` (capitalised stem before ``_ratio``)."""
    out = {}
    for c in cols:
        stem = c[: -len("_ratio")] if c.endswith("_ratio") else c
        out[c] = stem[:1].upper() + stem[1:]
    return out


def yesno_summary(df: DataFrame, perspectives: Sequence[str] | None = None,
                  metrics: Sequence[str] = ("care_ratio", "fairness_ratio", "loyalty_ratio", "authority_ratio"),
                  metric_names: Mapping[str, str] | None = None, answers: Sequence[str] = ("Yes", "No"),
                  row_key: Sequence[str] | str = "row_key", stat: str = "mean", ci: int = 95,
                  n_boot: int = 800, seed: int = 0, method: str = "mix32",
                  perspective: str = "perspective", answer: str = "answer") -> DataFrame:
    """Bootstrap per perspective x answer x metric, dense over the present
    perspectives (in ``perspectives`` order when given), all answers, all metrics."""
    spark = df.sparkSession
    d = df.where(F.col(answer).isin(list(answers)))
    if perspectives is not None:
        d = d.where(F.col(perspective).isin(list(perspectives)))
    res = bootstrap_ci(d, [perspective, answer], metrics, row_key, n_boot=n_boot, ci=ci, seed=seed,
                       stat=stat, method=method)
    # The result is small (groups x metrics): checkpoint it once, so the
    # perspectives present come from it instead of another scan of the rows.
    from vigil.session import materialize as _materialize
    res = _materialize(res)
    names = dict(metric_names or default_metric_names(metrics))
    ans = spark.createDataFrame([(a, i) for i, a in enumerate(answers)], f"{answer} string, answer_pos int")
    met = spark.createDataFrame([(m, names.get(m, m), i) for i, m in enumerate(metrics)],
                                "metric string, metric_name string, metric_pos int")
    present = res.select(perspective).where(F.col(perspective).isNotNull()).distinct()
    if perspectives is not None:
        order = spark.createDataFrame([(p, i) for i, p in enumerate(perspectives)],
                                      f"{perspective} string, perspective_pos int")
        present = present.join(order, perspective, "inner")
    else:
        present = present.withColumn("perspective_pos", F.lit(None).cast("int"))
    out = dense_skeleton(res, [present, ans, met], fill={"n": 0})
    return _summary_cols(out, perspective, answer, stat, ci)


def _summary_cols(out, perspective, answer, stat, ci):
    lo, hi = _names(ci)
    return out.select(perspective, answer, "metric", "metric_name", stat, lo, hi, "n",
                      "perspective_pos", "answer_pos", "metric_pos")
