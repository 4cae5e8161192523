"""Suffix-array removal against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from tests.conftest import SF001
from vigil.llm import suffix


def brute(rows, length):
    """``rows``: (id, text) in order; equal rows count as one document."""
    order, seen, marks = [], {}, {}
    for k, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        order.append((k, t))
    for k, t in order:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                m[p:p + length] = True
            else:
                seen[w] = 1
        marks[(k, t)] = m
    out = []
    for k, t in rows:
        b, m = (t or "").encode(), marks[(k, t)]
        spans = int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(m) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        out.append((k, len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r)[:5] for r in suffix.remove_repeats(df, length, **kw).collect()), key=str)


def test_matches_brute_force_on_the_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert run(spark, rows, 100) == brute(rows, 100)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij é"])
@pytest.mark.parametrize("hot", [200_000, 3])
def test_random_texts_with_shared_stretches(spark, alphabet, hot):
    rng = random.Random(len(alphabet) + hot)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(8)]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        a = rng.randint(0, len(t))
        rows.append((i, t[a:] + rng.choice(base)[:rng.randint(0, 100)] + rng.choice(base)[rng.randint(0, 20):]))
    rows.append((60, "a" * 500))
    assert run(spark, rows, 20, gram=8, block=2000, hot_gram=hot) == brute(rows, 20)


def test_nulls_repeats_and_order(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400))
    rows = [(5, long), (5, long), (3, long + "x"), (None, "zz" + long), (7, None), (8, ""), (9, "short"), (2, "é" * 150)]
    assert run(spark, rows, 100) == brute(rows, 100)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(empty).collect() == []
    extra = spark.createDataFrame([(1, "a" * 300, 5, "z")], "doc_id long, text string, k long, marks string")
    assert suffix.remove_repeats(extra).select("n_bytes", "n_removed", "n_spans").collect()[0] == (300, 299, 1)


def test_pieces_do_not_change_the_anchors(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    buf, s, e = np.frombuffer(data, np.uint8), np.array([0, 700, 700, 4000]), np.array([700, 700, 4000, 5000])
    whole = suffix.anchors(buf, s, e, 100, 32)
    monkeypatch.setattr(suffix, "PIECE", 300)
    cut = suffix.anchors(buf, s, e, 100, 32)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
