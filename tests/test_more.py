"""Densities from moments, entries of several words, agreement of runs: against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.text import longest_entries
from vigil.operators.agreement import coincidences, run_agreement
from vigil.operators.density import grouped_kde, grouped_kde_moments, series_error
from vigil.operators.lexicon import lexicon_scores

# ---------------------------------------------------------------- densities


def test_moments_equal_the_direct_sum(spark):
    rng = np.random.default_rng(5)
    rows = [("a", "p", float(x)) for x in rng.normal(0, 1, 700)] + [("a", "q", float(x)) for x in rng.exponential(3, 500)] \
        + [("b", "p", float(x)) for x in (*rng.normal(0, 1e-6, 40), 1e3)] + [("c", "p", 2.0)] * 9 + [("d", "p", None), ("d", "p", float("nan")), ("e", "p", 1.0)]
    df = spark.createDataFrame(rows, "model string, perspective string, v double")
    one = {(r["model"], r["perspective"], r["point"]): (r["x"], r["density"]) for r in grouped_kde(df, col="v").collect()}
    two = {(r["model"], r["perspective"], r["point"]): (r["x"], r["density"]) for r in grouped_kde_moments(df, col="v").collect()}
    assert one.keys() == two.keys() and len(one) == 600
    for k, (x, d) in one.items():
        assert two[k][0] == x and two[k][1] == pytest.approx(d, rel=1e-9, abs=1e-14)
    assert series_error() < 1e-15 < series_error(16)


def test_moments_shuffle_boxes_not_rows(spark):
    df = spark.range(20_000, numPartitions=2).selectExpr("'m' as model", "'p' as perspective", "sin(id) as v")
    out = grouped_kde_moments(df, col="v")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") <= 2 and "HashAggregate" in plan
    boxes = grouped_kde_moments(df, col="v", gridsize=2)
    assert boxes.count() == 2


# ---------------------------------------------------------------- entries of several words


def scan(tokens, entries):
    """Leftmost, longest first."""
    out, i = [], 0
    while i < len(tokens):
        for size in range(max(map(len, (e.split() for e in entries))), 0, -1):
            if i + size <= len(tokens) and " ".join(tokens[i:i + size]) in entries:
                out.append(" ".join(tokens[i:i + size]))
                i += size
                break
        else:
            i += 1
    return out


def test_longest_entries_equal_a_scan(spark):
    rng = random.Random(1)
    entries = ["a", "a b", "a b c", "b c", "c c c", "d a"]
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 40))],) for _ in range(300)] + [([],)]
    df = spark.createDataFrame(rows, "t array<string>")
    for r in df.select("t", longest_entries(F.col("t"), entries).alias("m")).collect():
        assert r["m"] == scan(r["t"], entries)
    assert df.select(longest_entries(F.col("t"), [])).first()[0] == []


def test_phrases_are_an_option(spark):
    df = spark.createDataFrame([(1, "Of the people, of  THE... of"), (2, None), (3, "")], "id int, body string")
    lex = spark.createDataFrame([("of", "a.x", 1), ("of the", "b.y", 2), ("Of-The", "b.z", 3), ("...", "c.x", 4)], "token string, category string, ordinal long")
    off = {r["id"]: r for r in lexicon_scores(df, lex, col="body", stopwords=None).collect()}
    on = {r["id"]: r for r in lexicon_scores(df, lex, col="body", stopwords=None, phrases=True, keep_matched=True).collect()}
    assert (off[1]["a_x_count"], off[1]["b_y_count"], off[1]["b_z_count"]) == (3, 0, 0)
    assert (on[1]["a_x_count"], on[1]["b_y_count"], on[1]["b_z_count"], on[1]["matched_count"]) == (1, 0, 2, 3)
    assert on[1]["b_ratio"] == pytest.approx(2 / 3) and on[2]["matched_count"] == on[3]["matched_count"] == 0
    with pytest.raises(ValueError):
        lexicon_scores(df, lex, col="body", phrases=True, strategy="join")


# ---------------------------------------------------------------- agreement


def plain_alpha(rows):
    """Krippendorff's alpha from all pairs of a unit's answers: (answers, observed, expected, alpha)."""
    units = {}
    for cell, a in rows:
        if a is not None and None not in cell:
            units.setdefault(cell, []).append(a)
    units = [u for u in units.values() if len(u) > 1]
    said = [a for u in units for a in u]
    observed = sum(sum(a != b for i, a in enumerate(u) for j, b in enumerate(u) if i != j) / (len(u) - 1) for u in units)
    expected = sum(a != b for i, a in enumerate(said) for j, b in enumerate(said) if i != j) / (len(said) - 1) if len(said) > 1 else 0
    return len(units), len(said), observed, expected, 1 - observed / expected if expected else None


def test_alpha_equals_all_pairs(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), "p", rng.choice([1, 2, None]), rng.randint(1, 6), rng.choice(["Yes", "Yes", "No", "maybe", None])) for _ in range(150)]
    rows += [("same", "p", 1, 1, "Yes")] * 4 + [("alone", "p", 1, i, "Yes") for i in range(3)] + [(None, "p", 1, 1, "Yes")] * 2
    df = spark.createDataFrame(rows, "model string, perspective string, closeness_level int, severity_level int, answer string")
    got = {r["model"]: r for r in run_agreement(df).collect()}
    assert set(got) == {"a", "b", "same"}
    for m, r in got.items():
        units, answers, observed, expected, alpha = plain_alpha([((c, s), a) for mm, _, c, s, a in rows if mm == m])
        assert (r["n_units"], r["n_answers"]) == (units, answers)
        assert r["observed"] == pytest.approx(observed) and r["expected"] == pytest.approx(expected)
        assert r["alpha"] == (None if alpha is None else pytest.approx(alpha))
    assert got["same"]["n_same"] == 1
    pairs = {(r["model"], r["first"], r["second"]): r["count"] for r in coincidences(df, ["Yes", "No", "maybe"]).collect()}
    for m in "ab":
        off = sum(v for (mm, x, y), v in pairs.items() if mm == m and x != y)
        assert off == pytest.approx(got[m]["observed"])
        assert sum(v for (mm, *_), v in pairs.items() if mm == m) == pytest.approx(got[m]["n_answers"])


def test_agreement_of_nothing(spark):
    df = spark.createDataFrame([], "model string, perspective string, closeness_level int, severity_level int, answer string")
    assert run_agreement(df).count() == 0 and coincidences(df, ["Yes"]).count() == 0
