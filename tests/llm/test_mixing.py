"""Source mixing: the knapsack against all subsets, targets against a plain loop, and the mix itself."""

import itertools
import random
from collections import defaultdict

import numpy as np

from tests.conftest import SF01
from vigil.llm import mixing


def test_fit_reaches_the_best_sum_of_the_rest():
    rng = random.Random(5)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 5))))
        counts = np.array([rng.randint(1, 3) for _ in sizes])
        budget = rng.uniform(0, float((sizes * counts).sum()))
        take = mixing.fit_lengths(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        base = np.floor(counts * (budget / (sizes * counts).sum())).astype(int)
        sums = [sum(int(s) * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(b, c + 1) for b, c in zip(base, counts)])]
        assert abs(int((take * sizes).sum()) - budget) <= min(abs(s - budget) for s in sums) + 1e-9


def test_fit_of_long_budgets_is_exact_or_within_one_document():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 20_000, 3000))
    counts = rng.integers(1, 2000, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.1, 0.37, 0.999):
        take = mixing.fit_lengths(sizes, counts, share * total)
        assert abs((take * sizes).sum() - share * total) <= 0.5
        assert (take <= counts).all()
    huge = mixing.fit_lengths(np.array([1_000_000]), np.array([3]), 1_400_000.0)
    assert huge.tolist() == [1]


def test_fit_of_few_long_documents_is_exact():
    """A sum that only the whole knapsack reaches, of documents longer than the program's least window."""
    assert mixing.fit_lengths(np.array([70_000, 71_000, 100_000]), np.array([1, 1, 1]), 141_000.0).tolist() == [1, 1, 0]
    assert mixing.fit_lengths(np.array([300_000, 301_000, 400_000, 10]), np.array([1, 1, 1, 1]), 601_000.0).tolist() == [1, 1, 0, 0]


def test_long_rests_prefer_no_length():
    """One document of each of many sizes: about the same share of short and of long ones is taken, near the budget."""
    sizes = np.arange(1, 6_001) * 7
    take = mixing.fit_lengths(sizes, np.ones(6_000, np.int64), 0.4 * sizes.sum())
    assert abs((take * sizes).sum() - 0.4 * sizes.sum()) <= 3.5
    for part in np.array_split(take, 6):
        assert 0.3 < part.mean() < 0.5


def targets(sizes, weights, share=1.5, cap=2.0):
    """Plain loop: what is above a cap is shared among the rest by weight."""
    budget, full = share * sum(sizes.values()), {s: cap * z for s, z in sizes.items()}
    fixed = set()
    while True:
        left = budget - sum(full[s] for s in fixed)
        w = sum(weights[s] for s in sizes if s not in fixed)
        t = {s: full[s] if s in fixed else weights[s] * left / w for s in sizes}
        over = {s for s in sizes if s not in fixed and t[s] > full[s]}
        if not over:
            return t
        fixed |= over


def check_mix(rows):
    """``rows``: (doc_id, source, size, source_size, target, taken)."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[1]] += r[2]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for _, s, size, source_size, target, got in rows:
        assert source_size == sizes[s] and abs(target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= got <= 2 * size and (size == 0 or got % size == 0)
        taken[s] += got
    for s in sizes:
        longest = max(r[2] for r in rows if r[1] == s)
        assert abs(taken[s] - want[s]) <= max(1, longest / 2)
    return taken, want


def test_given_documents_meet_their_targets_and_reruns_agree(spark):
    from vigil.llm.queries import QUERIES
    runs = [sorted(tuple(r)[:6] for r in QUERIES["op1_mix_sources"](spark, SF01).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 1000
    taken, want = check_mix(runs[0])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_hot_sources_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", rng.choice([1, 1, 1, 5, 9])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_sources(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert len(got) == 600
    check_mix([tuple(r) for r in got])


def test_nulls_repeats_clashes_and_given_weights(spark):
    rows = [(1, None, 10, "a", 3), (1, None, 10, "a", 3), (None, "x", None, "b", 4), (3, "x", 0, "c", 5), (4, "", 7, "d", 6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, target string, buckets long")
    got = mixing.mix_sources(df)
    assert got.count() == 5 and "buckets" in got.columns
    check_mix([tuple(r) for r in got.select("doc_id", "source", "size", "source_size", "target", "taken").collect()])
    assert mixing.mix_sources(df.limit(0)).count() == 0
    w = spark.createDataFrame([(None, 1.0), ("", 3.0)], "source string, weight double")
    t = {r["source"]: r["target"] for r in mixing.mix_sources(df, w, share=0.5).collect()}
    assert np.isclose(t[None], 20 * 0.5 * 27 / 40 * 0 + 0.25 * 13.5) and np.isclose(t[""], 0.75 * 13.5) and t["x"] == 0
