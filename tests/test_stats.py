"""Numerics against direct numpy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.hashing import mix32_uniforms, poisson1_thresholds
from vigil.functions.hashing import mix32_words, poisson1_from_words, row_seed
from vigil.operators import bootstrap as B
from vigil.operators.bootstrap import bootstrap_ci, yesno_summary
from vigil.operators.density import grouped_kde
from vigil.operators.regression import ols_hc3


def numpy_hc3(x1, x2, y):
    X = np.column_stack([np.ones_like(x1), x1, x2])
    xtx_inv = np.linalg.inv(X.T @ X)
    b = xtx_inv @ X.T @ y
    e = y - X @ b
    h = np.einsum("ij,jk,ik->i", X, xtx_inv, X)
    meat = (X * ((e / (1 - h)) ** 2)[:, None]).T @ X
    cov = xtx_inv @ meat @ xtx_inv
    return b, np.sqrt(np.diag(cov))


def test_ols_hc3_matches_numpy(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in ("a", "b"):
        n = 300
        x1 = rng.integers(1, 5, n).astype(float)
        x2 = rng.integers(1, 5, n).astype(float)
        y = 0.3 + 0.05 * x1 - 0.02 * x2 + rng.normal(0, 0.1 + 0.05 * x1, n)
        rows += [(g, float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)]
    df = spark.createDataFrame(rows, "model string, closeness_level double, severity_level double, care_ratio double")
    out = ols_hc3(df, keys=["model"], ys=["care_ratio"]).collect()
    for g in ("a", "b"):
        sel = [r for r in rows if r[0] == g]
        x1, x2, y = (np.array([r[i] for r in sel]) for i in (1, 2, 3))
        b, se = numpy_hc3(x1, x2, y)
        got = {r.term: r for r in out if r.model == g}
        for j, term in ((1, "closeness_level"), (2, "severity_level")):
            r = got[term]
            assert abs(r.coef - b[j]) < 1e-12 and abs(r.se - se[j]) < 1e-12
            assert abs(r.ci_low - (b[j] - 1.959963984540054 * se[j])) < 1e-12
            assert abs(r.p - math.erfc(abs(b[j] / se[j]) / math.sqrt(2))) < 1e-12
            assert r.n == 300


def test_ols_degenerate_groups(spark):
    rows = [("const", 1.0, float(i % 3), float(i)) for i in range(10)]              # constant regressor
    rows += [("three", float(i), float(i * i), float(2 * i)) for i in range(3)]   # 3 rows, 3 parameters
    rows += [("perfect", float(i % 4), float(i % 3), 1 + 2.0 * (i % 4) - (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "model string, closeness_level double, severity_level double, care_ratio double")
    out = {(r.model, r.term): r for r in ols_hc3(df, keys=["model"], ys=["care_ratio"]).collect()}
    assert out[("const", "closeness_level")].coef is None and out[("const", "closeness_level")].se is None
    assert out[("three", "closeness_level")].se is None                           # leverage 1
    p = out[("perfect", "closeness_level")]
    assert abs(p.coef - 2.0) < 1e-9 and p.se < 1e-9


def numpy_poisson_bootstrap(x, h, n_boot):
    w = np.searchsorted(np.asarray(poisson1_thresholds()), mix32_uniforms(h[:, None], np.arange(n_boot)[None, :]),
                        side="right").astype(float)
    stats = (w * x[:, None]).sum(0) / w.sum(0)
    return np.percentile(stats, [2.5, 97.5])


def test_bootstrap_matches_numpy_and_partitioning(spark):
    rng = np.random.default_rng(3)
    n = 500
    vals = rng.beta(2, 5, n)
    rows = [(f"k{i}", "g" if i % 2 else "h", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "row_key string, grp string, v double")
    a = {r.grp: r for r in bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=200).collect()}
    b = {r.grp: r for r in bootstrap_ci(df.repartition(7), ["grp"], ["v"], "row_key", n_boot=200).collect()}
    seeds = {r.row_key: r.h for r in df.select("row_key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("0"), "row_key")), 1, 8), 16, 10).cast("long").alias("h")).collect()}
    for g in ("g", "h"):
        assert a[g].ci95_low == pytest.approx(b[g].ci95_low, abs=1e-12)
        sel = [r for r in rows if r[1] == g]
        x = np.array([r[2] for r in sel])
        h = np.array([seeds[r[0]] for r in sel], dtype=np.uint64)
        lo, hi = numpy_poisson_bootstrap(x, h, 200)
        assert a[g].ci95_low == pytest.approx(lo, abs=1e-12) and a[g].ci95_high == pytest.approx(hi, abs=1e-12)
        assert a[g].mean == pytest.approx(x.mean(), abs=1e-12) and a[g].n == len(x)
        # the interval is close to the normal-theory one
        se = x.std(ddof=1) / math.sqrt(len(x))
        assert abs((hi - lo) / (2 * 1.96 * se) - 1) < 0.25


def test_bootstrap_engines_agree_in_distribution(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", "g", float(v)) for i, v in enumerate(rng.normal(0, 1, 2000))]
    df = spark.createDataFrame(rows, "row_key string, grp string, v double")
    m = bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=400).collect()[0]
    x = bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=400, method="xxhash64").collect()[0]
    width_m, width_x = m.ci95_high - m.ci95_low, x.ci95_high - x.ci95_low
    assert abs(width_m / width_x - 1) < 0.2


def test_bootstrap_median_and_empty(spark):
    rows = [(f"k{i}", "g", float(i)) for i in range(101)] + [("z", "e", None)]
    df = spark.createDataFrame(rows, "row_key string, grp string, v double")
    out = {r.grp: r for r in bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=100, stat="median").collect()}
    assert out["g"].median == 50.0 and out["g"].ci95_low < 50 < out["g"].ci95_high
    assert out["e"].n == 0 and out["e"].median is None and out["e"].ci95_low is None


def test_yesno_summary_dense(spark):
    rows = [(f"k{i}", "p", "Yes", 0.1 * (i % 5), 0.2) for i in range(20)]
    rows += [(f"j{i}", "q", "No" if i % 2 else "Yes", 0.3, 0.4) for i in range(20)]
    rows += [("x1", "q", "Maybe", 0.9, 0.9)]
    df = spark.createDataFrame(rows, "row_key string, perspective string, answer string, care_ratio double, "
                                     "fairness_ratio double")
    s = yesno_summary(df, perspectives=["q", "p", "absent"], metrics=["care_ratio", "fairness_ratio"], n_boot=50)
    got = {(r.perspective, r.answer, r.metric): r for r in s.collect()}
    assert len(got) == 8
    assert got[("p", "No", "care_ratio")].n == 0 and got[("p", "No", "care_ratio")].mean is None
    assert got[("q", "Yes", "fairness_ratio")].metric_name == "Fairness"
    assert got[("q", "No", "care_ratio")].perspective_pos == 0 and got[("q", "No", "care_ratio")].n == 10


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(11)
    vals = rng.beta(3, 3, 40)
    rows = [("m", "p", float(v)) for v in vals] + [("m", "flat", 0.5), ("m", "flat", 0.5), ("m", "one", 0.2)]
    df = spark.createDataFrame(rows, "model string, perspective string, report_ratio double")
    out = sorted((r.point, r.x, r.density) for r in grouped_kde(df).collect() if r.perspective == "p")
    assert {r.perspective for r in grouped_kde(df).collect()} == {"p"}        # zero-spread/one-value skipped
    bw = vals.std(ddof=1) * len(vals) ** (-0.2)
    grid = np.linspace(vals.min() - 2 * bw, vals.max() + 2 * bw, 200)
    dens = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / bw) ** 2).sum(1) / (len(vals) * bw * math.sqrt(2 * math.pi))
    assert len(out) == 200
    assert max(abs(a[1] - b) for a, b in zip(out, grid)) < 1e-12
    assert max(abs(a[2] - b) for a, b in zip(out, dens)) < 1e-12
    assert abs(np.trapezoid([o[2] for o in out], grid) - 1) < 0.01


def test_bootstrap_degenerate_inputs(spark):
    rows = [("single", "s0", 0.4), ("same", "a0", 0.25), ("same", "a1", 0.25), ("same", "a2", 0.25),
            ("nan", "n0", float("nan")), ("nan", "n1", 0.5), ("nan", "n2", None)]
    df = spark.createDataFrame(rows, "grp string, row_key string, v double")
    out = {r.grp: r for r in bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=100).collect()}
    assert out["single"].mean == 0.4 and out["single"].n == 1
    # replicates with weight 0 drop out; the others equal the value up to rounding of k*x/k
    assert out["single"].ci95_low == pytest.approx(0.4, abs=1e-15) and out["single"].ci95_high == pytest.approx(0.4, abs=1e-15)
    assert out["same"].ci95_low == pytest.approx(0.25, abs=1e-15) and out["same"].ci95_high == pytest.approx(0.25, abs=1e-15)
    assert out["nan"].n == 1 and out["nan"].mean == 0.5                        # NaN and NULL removed


def test_kde_single_group_output_shape(spark):
    df = spark.createDataFrame([("m", "p", float(i) / 10) for i in range(10)],
                               "model string, perspective string, report_ratio double")
    out = grouped_kde(df, gridsize=50).collect()
    assert len(out) == 50 and sorted(r.point for r in out) == list(range(50))


def test_bootstrap_median_bracket_matches_brute_force(spark):
    """The rank bracket's result must equal the of the expanded replicates, computed directly."""
    rng = np.random.default_rng(1)
    rows = [(i, "g" if i % 3 else "h", float(rng.normal()) if i % 17 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_key long, grp string, v double")
    out = {r.grp: r for r in bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=120, stat="median").collect()}
    hs = {r.row_key: r.h for r in df.select("row_key", row_seed(0, "row_key").alias("h")).collect()}
    for g in ("g", "h"):
        sel = [(k, v) for k, gg, v in rows if gg == g and v is not None]
        x = np.array([v for _, v in sel])
        h = np.array([hs[k] for k, _ in sel], dtype=np.int64).astype(np.uint32)
        w = poisson1_from_words(mix32_words(h[:, None], np.arange(120, dtype=np.uint32)[None, :]))
        lo, hi = np.percentile([np.median(np.repeat(x, w[:, b])) for b in range(120)], [2.5, 97.5])
        assert out[g].n == len(x) and abs(out[g].median - np.median(x)) < 1e-15
        assert abs(out[g].ci95_low - lo) < 1e-12 and abs(out[g].ci95_high - hi) < 1e-12


def test_bootstrap_median_blocks_do_not_change_results(spark, monkeypatch):
    """Splitting replicates over several blocks per group gives the same result."""
    rng = np.random.default_rng(5)
    rows = [(i, "g" if i % 4 else "h", float(rng.exponential())) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_key long, grp string, v double")
    one = {r.grp: r for r in bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=150, stat="median").collect()}
    monkeypatch.setattr(B, "WORK_PER_TASK", 1000)  # -> 3 blocks of replicates per group
    many = {r.grp: r for r in bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=150, stat="median").collect()}
    assert one == many and one["g"].n == 1500


def test_bootstrap_median_with_ties(spark):
    """A value that most rows share travels as summed weights; the medians stay exact."""
    rng = np.random.default_rng(9)
    rows = [(i, "g", 0.0 if i % 10 < 6 else float(rng.normal())) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_key long, grp string, v double").coalesce(2)
    r = bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=80, stat="median").first()
    hs = {x.row_key: x.h for x in df.select("row_key", row_seed(0, "row_key").alias("h")).collect()}
    x, h = np.array([v for _, _, v in rows]), np.array([hs[k] for k, _, _ in rows], dtype=np.int64).astype(np.uint32)
    w = poisson1_from_words(mix32_words(h[:, None], np.arange(80, dtype=np.uint32)[None, :]))
    lo, hi = np.percentile([np.median(np.repeat(x, w[:, b])) for b in range(80)], [2.5, 97.5])
    assert (r.median, r.n) == (np.median(x), 4000) and abs(r.ci95_low - lo) < 1e-12 and abs(r.ci95_high - hi) < 1e-12


@pytest.mark.parametrize("kind", ["string", "long"])
@pytest.mark.parametrize("stat", ["mean", "median"])
def test_bootstrap_drops_null_keys(spark, kind, stat):
    rows = [(i, None if i % 3 == 0 else "7", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_key long, grp string, v double").withColumn("grp", F.col("grp").cast(kind))
    out = bootstrap_ci(df, ["grp"], ["v"], "row_key", n_boot=20, stat=stat).collect()
    assert [(str(r.grp), r.n) for r in out] == [("7", 40)]


def test_ols_leverage_of_one_is_null_for_its_group_only(spark):
    shapes = [[(1, 1), (1, 2), (1, 4), (5, 1)], [(0, 0), (0, 1), (1, 0)], [(1, 1), (2, 2), (3, 3), (9, 1)]]
    rows = [(f"s{i}", float(a), float(b), float(a * 3 - b + a * b)) for i, s in enumerate(shapes) for a, b in s]
    rows += [("ok", float(i % 4), float(i % 3), float((i * 7) % 5)) for i in range(30)] + [(None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "model string, closeness_level double, severity_level double, care_ratio double")
    out = ols_hc3(df, keys=["model"], ys=["care_ratio"])
    got = out.collect()
    assert {r.model for r in got} == {"s0", "s1", "s2", "ok"}
    assert all((r.se is None) == (r.model != "ok") for r in got)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_scorers_keep_long_keys_and_are_built_once(spark):
    from functools import partial

    from vigil.operators.classify import classifier_scores
    from vigil.plans.stubs import length_scorer
    big = 9007199254740993
    df = spark.createDataFrame([(big, "abc"), (None, None), (big + 2, "abcd")], "k long, reason string")
    out = classifier_scores(df, {"a": partial(length_scorer, 2), "b": partial(length_scorer, 3)}).collect()
    got = {r.k: (r.a_mscore, r.b_mscore) for r in out}
    assert got[big] == (0.5, 0.0) and got[big + 2] == (0.0, 1 / 3) and got[None] == (None, None)


def test_normal_p_values_in_the_far_tail(spark):
    from vigil.functions.numeric import normal_two_sided_p
    zs = [0.0, 0.5, 2.4999, 2.5, 5.0, 8.0, 20.0, 37.0]
    got = [r.p for r in spark.createDataFrame([(z,) for z in zs], "z double").select(normal_two_sided_p("z").alias("p")).collect()]
    assert all(abs(p - math.erfc(z / math.sqrt(2))) <= 1e-12 * max(math.erfc(z / math.sqrt(2)), 1e-300) + 5e-15 for p, z in zip(got, zs))
