"""LM scoring: losses against plain counting, and held-out separation."""

import math
from collections import Counter

import numpy as np

from tests.conftest import SF01
from vigil.llm import lmscore


def test_losses_match_plain_counts(spark):
    docs = [(1, "a b a c"), (2, "b b A"), (3, ""), (None, "a z"), (5, None), (2, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(2,), (2,), (None,), (77,)], "doc_id long")
    got = sorted((r for r in lmscore.cross_entropy_difference(df, target).collect()), key=lambda r: (r["doc_id"] or 99, r["n_tokens"]))

    def model(texts, scale):
        one, ctx, two = Counter(), Counter(), Counter()
        for t in texts:
            w = (t or "").lower().split()
            for p, x in zip(["^"] + w, w):
                one[x] += scale
                ctx[p] += scale
                two[p, x] += scale
        return one, ctx, two, sum(one.values())

    def loss(m, t):
        one, ctx, two, n = m
        w = t.lower().split()
        return sum(-math.log((two[p, x] + lmscore.PRIOR * (one[x] + 1) / (n + 4)) / (ctx[p] + lmscore.PRIOR))  # a, b, c, z
                   for p, x in zip(["^"] + w, w)) / len(w)

    good = model(["b b A", "c"], 1.0)
    back = model([t for _, t in docs], 4 / 10)
    want = {(k, len((t or "").split())): t for k, t in docs}
    for r in got:
        t = want[(r["doc_id"], r["n_tokens"])]
        if not t:
            assert r["score"] is None and r["target_loss"] is None
        else:
            assert np.isclose(r["target_loss"], loss(good, t), rtol=1e-4)
            assert np.isclose(r["background_loss"], loss(back, t), rtol=1e-4)
            assert np.isclose(r["score"], r["target_loss"] - r["background_loss"])
    assert len(got) == len(docs)


def test_held_out_documents_are_ranked(spark):
    """Models learn from every second labelled document; the others are told apart by score."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    train = spark.createDataFrame([(r["doc_id"],) for r in labels if r["doc_id"] % 2 == 0 and r["quality"] == 1], "doc_id long")
    score = {r["doc_id"]: r["score"] for r in lmscore.cross_entropy_difference(docs, train).collect()}
    test = [(score[r["doc_id"]], r["quality"]) for r in labels if r["doc_id"] % 2 and score[r["doc_id"]] is not None]
    good, bad = [s for s, q in test if q == 1], [s for s, q in test if q == 0]
    wins = sum((g < b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    print("area under the curve", wins)
    assert wins > 0.7


def test_no_target_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    r = lmscore.cross_entropy_difference(df, none).first()
    assert np.isclose(r["target_loss"], math.log(2))  # uniform over the vocabulary
    assert lmscore.cross_entropy_difference(df.limit(0), none).count() == 0


def test_rare_words_share_no_counts(spark, monkeypatch):
    """5,000 words that occur once or twice, in documents that are repeated too, against plain counts."""
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(f"w{i}" for i in rng.integers(0, 5000, 40)) + " the end") for k in range(150)]
    docs += [docs[7], docs[7], (None, docs[8][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    good = {k for k in range(0, 150, 3)}
    counts = {True: (Counter(), Counter(), Counter()), False: (Counter(), Counter(), Counter())}
    for k, t in docs:
        w = t.split()
        for flag in {False, k in good}:
            for c, x in zip(counts[flag], (w, ["^"] + w[:-1], list(zip(["^"] + w, w))), strict=True):
                c.update(x)

    def loss(flag, t, scale, size):
        one, ctx, two = counts[flag]
        w, n = t.split(), sum(one.values()) * scale
        return sum(-math.log((two[p, x] * scale + lmscore.PRIOR * (one[x] * scale + 1) / (n + size)) / (ctx[p] * scale + lmscore.PRIOR))
                   for p, x in zip(["^"] + w, w)) / len(w)

    scale = sum(counts[True][0].values()) / sum(counts[False][0].values())
    target = spark.createDataFrame([(k,) for k in good], "doc_id long")
    vocabulary = len(counts[False][0])
    for slice_bytes, fragment_bytes in ((1 << 24, 1 << 24), (8_000, 2_000), (1_000, 9_000)):  # one slice a task, some, many
        monkeypatch.setattr(lmscore, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(lmscore, "FRAGMENT_BYTES", fragment_bytes)
        got = lmscore.cross_entropy_difference(df, target).collect()
        assert len(got) == len(docs)
        text = dict(docs)
        for r in got:
            t = text[r["doc_id"]]
            assert r["n_tokens"] == 42
            assert np.isclose(r["target_loss"], loss(True, t, 1.0, vocabulary), rtol=1e-9)
            assert np.isclose(r["background_loss"], loss(False, t, scale, vocabulary), rtol=1e-9)


def test_packed_columns_come_back():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 1 << 63, 50, dtype=np.uint64)), np.zeros(7, np.uint64), np.zeros(0, np.uint64), np.array([255, 256, 0], np.uint64)]
    for want, got in zip(columns, lmscore.unpack(lmscore.pack(*columns)), strict=True):
        assert (want == got).all()
