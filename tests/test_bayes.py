"""M1's native default: closed form against plain Python, folds by subtraction, held-out quality."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.functions.text import token_counts
from vigil.operators.bayes import bayes_scores, fit_bayes

TRAIN = "doc_id long, text string, a int, b int"


def plain(train, text, label, fold, folds):
    """Score of one text by a model trained anew on the rows of the other folds."""
    rows = [(t, y) for i, t, *ys in train if (y := ys[label]) in (0, 1) and (fold is None or i % folds != fold)]
    n = {0: {}, 1: {}}
    for t, y in rows:
        for w in re.findall("[a-zA-Z]+", (t or "").lower()):
            n[y][w] = n[y].get(w, 0) + 1
    v = len(set(n[0]) | set(n[1]))
    s = math.log((sum(y for _, y in rows) + 1) / (sum(1 - y for _, y in rows) + 1))
    for w in re.findall("[a-zA-Z]+", (text or "").lower()):
        if w in n[0] or w in n[1]:
            s += math.log((n[1].get(w, 0) + 1) / (sum(n[1].values()) + v)) - math.log((n[0].get(w, 0) + 1) / (sum(n[0].values()) + v))
    return 1 / (1 + math.exp(-max(min(s, 700), -700)))


def rows(rng, n=60):
    words = ["good", "bad", "Fine", "poor", "x1", "été", "the", "Of"]
    out = [(i, " ".join(rng.choice(words[:4 + i % 5]) for _ in range(rng.randint(0, 12))), rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(n)]
    return out + [(n, None, 1, 0), (n + 1, "", 0, 1), *out[:5], (n + 2, "only here zebra zebra", 1, 1)]


def test_equal_to_models_trained_without_the_fold(spark):
    train = rows(random.Random(3))
    df = spark.createDataFrame(train, TRAIN)
    model = fit_bayes(df, "text", ["a", "b"], F.col("doc_id") % 4, 4)
    for r in bayes_scores(df, model, "text", fold=F.col("doc_id") % 4).collect():
        for i, c in enumerate("ab"):
            assert r[f"{c}_mscore"] == pytest.approx(plain(train, r["text"], i, r["doc_id"] % 4, 4), abs=1e-12)
    for r in bayes_scores(df, model, "text").collect():
        assert r["a_mscore"] == pytest.approx(plain(train, r["text"], 0, None, 4), abs=1e-12)


def test_broadcast_and_shuffle_give_the_same_and_rows_stay(spark):
    train = rows(random.Random(4))
    df = spark.createDataFrame(train, TRAIN).withColumn("n", F.lit(7)).withColumn("token", F.lit("z"))
    model = fit_bayes(df, "text", ["b"], F.col("doc_id") % 3, 3)
    one = bayes_scores(df, model, "text", fold=F.col("doc_id") % 3)
    two = bayes_scores(df, model, "text", fold=F.col("doc_id") % 3, max_broadcast_tokens=0)
    assert one.columns == [*df.columns, "b_mscore"]
    key = lambda d: sorted((r["doc_id"], round(r["b_mscore"], 12)) for r in d.collect())
    assert len(key(one)) == len(train) and key(one) == key(two)


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([], TRAIN)
    model = fit_bayes(df, "text", ["a"], F.col("doc_id") % 2, 2)
    assert bayes_scores(df, model, "text").count() == 0
    some = spark.createDataFrame([(1, "good", 1, 1)], TRAIN)
    assert bayes_scores(some, model, "text").first()["a_mscore"] == 0.5


def test_held_out_scores_find_classes_that_differ_in_words(spark):
    rng = random.Random(6)
    common, own = [f"w{chr(97 + i)}" for i in range(20)], {0: ["dull", "grey"], 1: ["bright", "keen"]}
    train = []
    for i in range(400):
        y = i % 3 == 0
        train.append((i, " ".join(rng.choices(common, k=12) + rng.choices(own[int(y)], k=2)), int(y), int(rng.random() < 0.5)))
    df = spark.createDataFrame(train, TRAIN)
    fold = F.pmod(F.xxhash64("text"), F.lit(5))  # equal texts share a fold
    model = fit_bayes(df, "text", ["a", "b"], fold, 5)
    got = bayes_scores(df, model, "text", fold=fold).collect()
    hits = lambda c: sum((r[f"{c}_mscore"] > 0.5) == (r[c] == 1) for r in got) / len(got)
    assert hits("a") > 0.95
    assert hits("b") < 0.65  # labels by chance: a model that had seen the rows would do better


def test_token_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["x"],)], "t array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(token_counts(F.col("t"))).collect()]
    assert got == [[("a", 1), ("b", 3)], [], [("x", 1)]]


def test_logistic_pipeline_still_scores(spark):
    from vigil.operators.classify import apply_text_classifiers, train_text_classifiers

    train = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", i % 2, 0) for i in range(40)], TRAIN)
    models = train_text_classifiers(train, "text", ["a"], num_features=1 << 8, max_iter=10)
    got = apply_text_classifiers(train, models, text_col="text").collect()
    assert all((r["a_mscore"] > 0.5) == (r["a"] == 1) for r in got)
