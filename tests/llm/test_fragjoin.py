"""N-gram Jaccard join against all pairs."""

import random

import pytest

from tests.conftest import SF001
from vigil.llm import fragjoin
from vigil.llm.fragjoin import ngram_jaccard


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j > i}:
            c = len(s & sets[j])
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, 1 << 70), 1 << 69 if k is None else k)
    return sorted(((k, len(s), None if least[find(i)] == 1 << 69 else least[find(i)])
                   for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def run(spark, rows, n, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in ngram_jaccard(df, n, percent).collect()), key=str)


def test_matches_all_pairs_on_the_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


@pytest.mark.parametrize("seed,percent,short", [(1, 85, 32), (2, 60, 32), (3, 80, 32), (4, 80, 2), (5, 60, 1)])
def test_matches_all_pairs_on_groups_of_near_copies(spark, monkeypatch, seed, percent, short):
    monkeypatch.setattr(fragjoin, "SHORT_LIST", short)
    monkeypatch.setattr(fragjoin, "BLOCK_MEMBERS", 7)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                p = rng.randrange(len(w))
                w[p:p + rng.randint(0, 2)] = [rng.choice(vocab) for _ in range(rng.randint(0, 2))]
            rows.append((len(rows), " ".join(w)))
    shared = " ".join(rng.choice(vocab) for _ in range(20))
    rows += [(len(rows) + i, shared + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(20)]
    assert run(spark, rows, 4, percent) == brute(rows, 4, percent)


def test_nulls_short_texts_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B\x0b"), (5, "a  B\x0b"), (None, "a b"), (None, "x y z u v"),
            (9, "a b"), (10, "É b"), (11, "é b"), (12, "a b a b a b a b"), (12, "q " * 5000)]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)
    df = spark.createDataFrame([(1, "a b c d", 5, "z")], "doc_id long, text string, n long, cls string")
    assert [tuple(r) for r in ngram_jaccard(df).collect()] == [(1, 1, 1)]
    assert ngram_jaccard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
