"""Connected components against union-find."""

import random

import pytest

from vigil.llm import components


def brute(edges):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("few", [200_000, 3])
def test_matches_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(components, "DEFAULT_MAX_BROADCAST_ROWS", few)
    rng = random.Random(few)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(-7, 3), (3, -7), (-9, -7)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.v: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
