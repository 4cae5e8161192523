"""Hard negatives: exact scores from residues, and the whole selection against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import rnsmine

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, n_pos=5, n_neg=5, low=80, high=100, scale=256):
    """All anchor rows against all other rows, in Python integers."""
    keep = [(v, l, [int(np.floor(scale * float(x))) for x in e]) for v, e, l in rows
            if l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda s: sorted(s, key=lambda t: (-t[1], t[0] is None, t[0] or 0))
    out = []
    for i, (v, l, q) in enumerate(keep):
        if v is None or v % 100:
            continue
        others = [(w, m, dot(q, r)) for j, (w, m, r) in enumerate(keep) if j != i]
        for pid, ps in first([(w, s) for w, m, s in others if m == l])[:n_pos]:
            fit = first([(w, s) for w, m, s in others if m != l and low * ps <= 100 * s <= high * ps])[:n_neg]
            out += [(v, pid, k + 1, w, ps, s) for k, (w, s) in enumerate(fit)]
    return out


def key(rows):
    return sorted((tuple((x is None, x or 0) for x in r) for r in rows))


def mined(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in rnsmine.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()]


@pytest.mark.parametrize("dims, top", [(1, 5), (3, 4_000), (64, 300), (700, 2_000), (3_000, 90_000)])
def test_scores_from_residues_are_exact(dims, top):
    rng = np.random.default_rng(dims)
    a, b = rng.integers(-top, top + 1, (7, dims)), rng.integers(-top, top + 1, (9, dims))
    a[0], b[0], b[1] = top, top, -top  # the bound itself, with both signs
    primes, span = rnsmine.residue_primes(dims * top * top, dims)
    assert span * max(p // 2 for p in primes) ** 2 <= rnsmine.EXACT
    got = rnsmine.scores(rnsmine.residues(a, primes), rnsmine.residues(b, primes), primes, span)
    assert (got == a @ b.T).all()


def test_equal_to_a_plain_version_with_ties_copies_and_nulls(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(420):
        e = [rng.choice([0.0, 0.25, 0.5, -0.25, 0.11]) + (0.01 if i % 3 else 0) for _ in range(6)]
        rows.append((rng.choice([i, i, i * 100 % 700, None]), e, rng.choice([0, 1, 1, 2, None])))
    rows += rows[:90] + [rows[7]] * 12 + [(100, [0.5] * 6, 1)] * 8 + [(i, [0.5] * 6, i % 2) for i in range(900, 960)]
    rows += [(200, None, 1), (300, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (400, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 0),
             (600, [], 1), (0, [0.5, 0.25], 1), (-100, [0.5] * 9, 0)]
    assert key(mined(spark, rows)) == key(plain(rows))
    monkeypatch.setattr(rnsmine, "ANCHOR_BLOCK", 20)
    monkeypatch.setattr(rnsmine, "ROW_SLICE", 300)
    monkeypatch.setattr(rnsmine, "TILE_ROWS", 16)
    assert key(mined(spark, rows, n_positives=2, n_negatives=3, low_percent=50, high_percent=90)) == key(plain(rows, 2, 3, 50, 90))


def test_large_components_take_more_primes_or_raise(spark):
    rng = random.Random(9)
    rows = [(i * 50, [float(np.float32(rng.uniform(-9000, 9000))) for _ in range(5)], i % 2) for i in range(40)]
    assert key(mined(spark, rows, scale=1)) == key(plain(rows, scale=1))
    with pytest.raises(ValueError):
        mined(spark, [(0, [3e30], 1)])


def test_empty_tables_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1)]) == []
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.4], 2)]
    more = [(*r, "x", 1, 2) for r in rows]
    assert mined(spark, more, SCHEMA + ", anchor_id string, __is_anchor int, __q int") == plain(rows)


def test_query(spark, tmp_path):
    from vigil.llm import queries

    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.choice([3, 9, 3])) for i in range(330)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in queries.op11(spark, str(tmp_path)).collect()]
    rows = [(v, [float(np.float32(x)) for x in e], (l + 1) % 10 if v % 7 == 0 else l) for v, e, l in rows]
    assert key(got) == key(plain(rows))
