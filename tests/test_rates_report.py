"""Aggregates and report shaping."""

import math

from pyspark.sql import functions as F

from vigil.operators import classify as M
from vigil.operators import rates as R
from vigil.operators import report as P

SCHEMA = "model string, perspective_run string, closeness_level int, severity_level int, answer string"


def test_yes_ratios_edges(spark):
    rows = [("m", "a_1", 1, 4, "Yes"), ("m", "a_2", 1, 4, None), ("m", "a_3", 2, 2, "yes"), ("m", "b", 2, 3, "Yes")]
    df = spark.createDataFrame(rows, SCHEMA)
    r = R.yes_ratios(df, expected_rows=1296).collect()[0]
    assert r.response_rate == round(4 / 1296, 3)
    assert r.overall_yes_ratio == 0.5                   # null and lower-case yes count as not Yes
    assert r.closeness1_severity4_yes_ratio == 0.5
    assert r.closeness4_severity1_yes_ratio is None      # empty corner cell
    st = {(x.model, x.perspective): x for x in R.stats_by_model_perspective(df).collect()}
    assert set(st) == {("m", "a"), ("m", "b")}          # runs pooled, x_1..x_3 -> x


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.0625,), (0.0635,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 3)).collect()] == [0.062, 0.064]


def test_report_ratio_nulls(spark):
    rows = [(1, "c1", 1, "m", "p", "Yes", 0.5), (1, "c1", 1, "m", "p", "No", float("nan")),
            (None, "c1", 1, "m", "p", "Yes", 0.9), (1, "c1", 1, "m", "p", None, 0.1)]
    df = spark.createDataFrame(rows, "closeness_level int, closeness_level_name string, severity_level int, "
                                     "model string, perspective string, answer string, care_ratio double")
    out = R.report_ratio(df, value_cols=["care_ratio"]).collect()
    assert len(out) == 1
    assert abs(out[0].report_ratio - 1 / 3) < 1e-15 and abs(out[0].care_ratio - 0.3) < 1e-15


def test_pivot_matrix_missing_cell(spark):
    rows = [("m", "p", 1, 1, 0.2), ("m", "p", 1, 2, 0.4), ("m", "p", 2, 1, 0.6), ("m", "q", 3, 4, 1.0)]
    df = spark.createDataFrame(rows, "model string, perspective string, severity_level int, closeness_level int, "
                                     "report_ratio double")
    out = {(r.model, r.perspective, r.severity_level): r for r in P.pivot_matrix(df).collect()}
    assert len(out) == 6                                   # 1 model x 2 perspectives x 3 observed severities
    assert out[("m", "p", 2)].c2 is None and out[("m", "p", 2)].c1 == 0.6
    assert out[("m", "p", 3)].c1 is None                   # severity seen elsewhere only
    assert out[("m", "q", 3)].c4 == 1.0


def test_gap_clusters_tolerance_inclusive(spark):
    # binary-exact values: gaps 0.03125 (<= 0.035) chain; 0.0625 breaks
    rows = [("m", "a", 0.5), ("m", "b", 0.53125), ("m", "c", 0.5625), ("m", "d", 0.625), ("n", "a", 0.1)]
    df = spark.createDataFrame(rows, "model string, perspective string, median double")
    cl = {(r.model, r.perspective): r.cluster for r in P.gap_clusters(df).collect()}
    assert cl == {("m", "a"): 0, ("m", "b"): 0, ("m", "c"): 0, ("m", "d"): 1, ("n", "a"): 0}
    exact = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.5 + 0.03125)], "model string, perspective string, median double")
    assert {r.cluster for r in P.gap_clusters(exact, tol=0.03125).collect()} == {0}
    an = {r.perspective: r for r in P.cluster_anchor(P.gap_clusters(df), priority={"c": 0, "a": 1}).collect()
          if r.model == "m"}
    assert an["c"].member_rank == 1 and an["a"].member_rank == 2 and an["b"].priority == 999
    assert an["a"].cluster_size == 3 and abs(an["a"].cluster_mean - (0.5 + 0.53125 + 0.5625) / 3) < 1e-15


def test_model_order_and_levels(spark):
    st = spark.createDataFrame([("x", "p", 0.2), ("y", "p", 0.5), ("z", "p", 0.5), ("x", "q", 0.9)],
                               "model string, perspective string, overall_yes_ratio double")
    first = [r.model for r in R.model_order(st, first="p").orderBy("rank").collect()]
    assert first == ["y", "z", "x"]
    mean = [r.model for r in R.model_order(st).orderBy("rank").collect()]
    assert mean == ["x", "y", "z"]
    lv = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 1), (None, "z", 0)], "l int, n string, o int")
    assert {r.l: r.n for r in R.level_names(lv, "l", "n", order="o").collect()} == {1: "a"}


def test_membership_order_head_union(spark):
    df = spark.createDataFrame([("b", 1), ("c", 2), ("b", 3)], "k string, v int")
    assert [(r.k, r.order_pos) for r in P.membership(df, "k", ["a", "b", "c"]).collect()] == [("b", 2), ("c", 3)]
    assert [r.k for r in P.explicit_order(df, "k", ["c", "b"]).collect()] == ["c", "b", "b"]
    assert [r.v for r in P.head_n(df, 2, [F.col("v").desc()]).collect()] == [3, 2]
    u = P.union_runs([df, spark.createDataFrame([("z", 1.5)], "k string, w double")])
    assert u.columns == ["k", "v", "w"] and u.where("k = 'z'").collect()[0].v is None


def test_classifier_ratio_chain(spark):
    df = spark.createDataFrame([(1, 0.2, 0.2, 0.0, 0.0, 0.6), (2, 0.0, 0.0, 0.0, 0.0, 0.0),
                                (3, 0.0, 0.0, 0.0, 0.0, 0.5), (4, None, 0.5, 0.5, 0.0, 0.0)],
                               "id int, care_mscore double, fairness_mscore double, loyalty_mscore double, "
                               "authority_mscore double, sanctity_mscore double")
    r = {x.id: x for x in M.ratios_from_scores(df).collect()}
    assert r[2].care_ratio is None and r[2].total_count == 0.0          # 0 total -> NULL ratio
    assert abs(r[1].sanctity_ratio - 0.6) < 1e-15 and abs(r[4].fairness_ratio - 0.5) < 1e-15
    rn = {x.id: x for x in M.renormalise(M.ratios_from_scores(df)).collect()}
    assert set(rn) == {1, 4}                                              # all zero / only sanctity dropped
    assert abs(sum(rn[1][c] for c in M.MORAL4) - 1.0) < 1e-12


def test_profile_and_median(spark):
    df = spark.createDataFrame([("m", "p", 0.1), ("m", "p", 0.3), ("m", "p", float("nan")), ("m", "q", None)],
                               "model string, perspective string, report_ratio double")
    med = {r.perspective: r.median for r in R.group_median(df).collect()}
    assert med == {"p": 0.2}                                              # NaN skipped, empty group absent
    pm = R.profile_means(df, value_cols=["report_ratio"], long=True).collect()
    assert {(r.perspective, r.metric) for r in pm} == {("p", "report_ratio"), ("q", "report_ratio")}
    assert math.isclose([r.value for r in pm if r.perspective == "p"][0], 0.2)


def test_sorted_median_matches_exact(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [("big", float(v)) for v in rng.normal(0, 1, 40_001)]
    rows += [("even", float(v)) for v in rng.integers(0, 50, 1000)] + [("one", 3.0), ("dup", 1.0), ("dup", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {r.g: r.median for r in R.group_median(df, ["g"], "v", method="exact").collect()}
    for kw in ({},):
        got = {r.g: r.median for r in R.group_median(df, ["g"], "v", **kw).collect()}
        assert got == exact
    assert exact["big"] == float(np.median([r[1] for r in rows if r[0] == "big"]))


def test_global_row_number_across_partitions(spark):
    from vigil.operators.report import global_row_number
    df = spark.range(5000).select(F.col("id"), ((F.col("id") * 7919) % 613).alias("score")).repartition(9)
    out = global_row_number(df, [F.col("score").desc(), "id"], "pos").collect()
    expect = sorted(((r.score, r.id) for r in out), key=lambda t: (-t[0], t[1]))
    got = {r.id: r.pos for r in out}
    assert sorted(got.values()) == list(range(1, 5001))
    assert all(got[i] == k + 1 for k, (_, i) in enumerate(expect))


def test_dense_skeleton_bounds_its_product(spark):
    import pytest
    vals = spark.createDataFrame([("a", 1, 5)], "m string, k int, n int")
    ms = spark.createDataFrame([(x,) for x in "abc"], "m string")
    ks = spark.createDataFrame([(i,) for i in range(3)], "k int")
    out = P.dense_skeleton(vals, [ms, ks], fill={"n": 0}).collect()
    assert len(out) == 9 and sum(r.n for r in out) == 5
    with pytest.raises(ValueError):
        P.dense_skeleton(vals, [ms, ks], max_rows=8)


def test_median_with_most_values_tied(spark):
    df = spark.range(30000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 10 < 7, 0.0)
                                   .otherwise(F.rand(3)).alias("v")).repartition(6)
    df = df.unionByName(spark.createDataFrame([(None, 1.0), ("x", None), ("x", float("nan")), ("y", 2.0)], "g string, v double"))
    got = {r.g: r.median for r in R.group_median(df, keys=["g"], col="v").collect()}
    assert got == {"0": 0.0, "1": 0.0, "2": 0.0, "y": 2.0}
    plan = R.group_median(df, keys=["g"], col="v")
    assert plan.count() == 4
