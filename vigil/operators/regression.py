"""Grouped OLS ``y ~ 1 + x1 + x2`` with HC3 standard errors.

One pass over the rows, no per-group Python: rows collapse to cells of equal
(keys, x1, x2) with the count, mean and population variance of every outcome.
Everything else comes from that table, centred on the group means: slopes by
the closed-form 2x2 solve; per cell the residual e of its mean, the leverage
h = 1/n + d'S^-1 d and q = S^-1 d (d = the centred regressors); HC3 variances
are sums over cells of n * (var + e^2) / (1 - h)^2 * q^2.

A singular group (constant or collinear regressor) or a row with h = 1 gives
NULL statistics for its group only.  p-values use the normal distribution (z
test) through a native erfc expression, so the whole plan stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import nan_to_null, normal_two_sided_p
from vigil.plans.sizing import bounded_broadcast
from vigil.session import materialize

def normal_quantile(level: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(0.5 + level / 2.0)


def ols_hc3(df: DataFrame, keys: Sequence[str] = ("model", "perspective"),
            ys: Sequence[str] = ("care_ratio", "fairness_ratio", "loyalty_ratio", "authority_ratio"),
            xs: Sequence[str] = ("closeness_level", "severity_level"), level: float = 0.95,
            outcome: str = "moral", eps: float = 1e-12, p_values: bool = True,
            max_groups: int = 1_000_000) -> DataFrame:
    if len(xs) != 2:
        raise ValueError("ols_hc3 fits exactly two regressors")
    keys = list(keys)
    x1, x2 = xs
    x = [F.col(c).cast("double") for c in xs]
    d = df.select(*keys, x[0].alias("__x1"), x[1].alias("__x2"), *[nan_to_null(y).alias(f"__y{i}") for i, y in enumerate(ys)]) \
        .where(F.col("__x1").isNotNull() & F.col("__x2").isNotNull())
    for k in keys:  # as pandas' groupby
        d = d.where(F.col(k).isNotNull())
    # Leverage and fitted value are the same for all rows of a regressor cell,
    # so a cell's count, mean and variance of each outcome are all that is
    # needed: the only pass over the rows, and the only shuffle of more than cells.
    moments = []
    for i in range(len(ys)):
        y = F.col(f"__y{i}")
        moments += [F.count(y).alias(f"__n{i}"), F.avg(y).alias(f"__m{i}"), F.var_pop(y).alias(f"__v{i}")]
    cells = d.groupBy(*keys, "__x1", "__x2").agg(*moments)
    per = [F.struct(F.lit(y).alias(outcome), F.col(f"__n{i}").alias("c"), F.col(f"__m{i}").alias("m"), F.col(f"__v{i}").alias("v"))
           for i, y in enumerate(ys)]
    cells = cells.select(*keys, "__x1", "__x2", F.explode(F.array(*per)).alias("__o")).select(*keys, "__x1", "__x2", "__o.*") \
        .where(F.col("c") > 0)
    cells = materialize(cells)
    gk = [*keys, outcome]

    n = F.sum("c")
    s = cells.groupBy(*gk).agg(n.alias("n"), (F.sum(F.col("c") * F.col("__x1")) / n).alias("m1"),
                               (F.sum(F.col("c") * F.col("__x2")) / n).alias("m2"), (F.sum(F.col("c") * F.col("m")) / n).alias("my"))
    d1, d2 = F.col("__x1") - F.col("m1"), F.col("__x2") - F.col("m2")
    dy = F.col("m") - F.col("my")
    # one row per group, written once: neither its size check nor its join re-runs what made it
    t = cells.join(bounded_broadcast(materialize(s), max_groups), gk).groupBy(*gk, "n", "m1", "m2", "my").agg(
        F.sum(F.col("c") * d1 * d1).alias("s11"), F.sum(F.col("c") * d2 * d2).alias("s22"), F.sum(F.col("c") * d1 * d2).alias("s12"),
        F.sum(F.col("c") * d1 * dy).alias("s1y"), F.sum(F.col("c") * d2 * dy).alias("s2y"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    ok = (det > F.lit(eps) * F.col("s11") * F.col("s22")) & (F.col("s11") > 0) & (F.col("s22") > 0)
    t = t.withColumn("det", F.when(ok, det))
    t = t.withColumns({
        "b1": (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / F.col("det"),
        "b2": (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / F.col("det"),
    })
    rows = cells.join(bounded_broadcast(materialize(t), max_groups), gk)
    q1 = (F.col("s22") * d1 - F.col("s12") * d2) / F.col("det")
    q2 = (F.col("s11") * d2 - F.col("s12") * d1) / F.col("det")
    e = dy - F.col("b1") * d1 - F.col("b2") * d2  # residual of the cell's mean
    h = F.lit(1.0) / F.col("n") + d1 * q1 + d2 * q2
    # sum of squared residuals of the cell's rows; a leverage of 1 makes the group's errors NULL
    squares = F.col("c") * (F.col("v") + e * e)
    w = F.try_divide(squares, F.pow(F.lit(1.0) - h, 2))
    meat = rows.groupBy(*gk, "n", "b1", "b2").agg(
        F.sum(w * q1 * q1).alias("v1"), F.sum(w * q2 * q2).alias("v2"), F.max(h).alias("hmax"))
    good_h = F.col("hmax") < F.lit(1.0 - eps)
    z = normal_quantile(level)
    pieces = []
    for term, b, v in ((x1, "b1", "v1"), (x2, "b2", "v2")):
        se = F.when(good_h & F.col(b).isNotNull(), F.sqrt(F.col(v)))
        pieces.append(F.struct(F.lit(term).alias("term"), F.col(b).alias("coef"), se.alias("se")))
    out = meat.select(*gk, F.col("n").cast("long").alias("n"), F.explode(F.array(*pieces)).alias("t")) \
        .select(*gk, "t.term", "t.coef", "t.se", "n")
    out = out.withColumns({
        "ci_low": F.col("coef") - F.lit(z) * F.col("se"),
        "ci_high": F.col("coef") + F.lit(z) * F.col("se"),
    })
    if p_values:
        zstat = F.try_divide(F.col("coef"), F.nullif(F.col("se"), F.lit(0.0)))
        out = out.withColumn("__z", zstat).withColumn("p", normal_two_sided_p("__z")).drop("__z")
    return out.select(*gk, "term", "coef", "se", "ci_low", "ci_high", *(["p"] if p_values else []), "n")
