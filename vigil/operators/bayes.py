"""M1's native default: multinomial naive Bayes in closed form, with held-out scores.

Training is one aggregate: per token and fold, its occurrences in the rows of each
class of each label.  A row of fold f is scored by the model of all other folds,
whose counts are the totals minus the fold's own, so no second pass trains it.  The
score of class 1 is ``1 / (1 + exp(-s))`` with

    s = ln((D1 + 1) / (D0 + 1)) + sum over tokens t of n(t) * w(t)
    w(t) = ln((N1(t) + a) / (N1 + a V)) - ln((N0(t) + a) / (N0 + a V))

D: rows of a class, N: tokens, V: different tokens, all outside fold f; a: the
smoothing.  A token that no other fold has is left out.  A null fold takes all folds.

Scale: rows become (token, count) vectors before anything is exploded; counts
combine map-side; the model has one row per token, whatever the number of folds; only
(text digest, fold, token, count) meets it, never the text; equal texts of a fold are
scored once.  The model is broadcast behind a size check, else joined by token.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import token_counts, tokenize
from vigil.plans.sizing import bounded_broadcast
from vigil.session import materialize

#: Beyond this a score's probability is 0 or 1 to the last digit, and ``exp`` would overflow.
MAX_LOG_ODDS = 700.0


@dataclass(frozen=True)
class BayesModel:
    """Token weights (token, one array of ``folds`` + 1 weights per label) and the log prior odds per label and fold."""
    weights: DataFrame
    priors: list[list[float]]
    labels: list[str]
    folds: int


def fit_bayes(train: DataFrame, text: str, labels: Sequence[str], fold: str | Column, folds: int,
              smoothing: float = 1.0) -> BayesModel:
    """Train one two-class model per label column (1, 0; other values and nulls take no part).

    ``fold``: column with 0 .. ``folds`` - 1; rows outside that range or with a null fold count in every fold's model.
    """
    labels = list(labels)
    fold = F.col(fold) if isinstance(fold, str) else fold
    rows = train.select(F.coalesce(fold.cast("int"), F.lit(-1)).alias("__f"), *[F.col(c).alias(f"__y{i}") for i, c in enumerate(labels)],
                        F.col(text).alias("__text"))

    def split(amount: Column, name: str) -> list[Column]:
        """Sums by label, class and fold; the last of each is the total."""
        out = []
        for i in range(len(labels)):
            for c in (1, 0):
                there = F.col(f"__y{i}") == c
                out += [F.sum(F.when(there & (F.col("__f") == f), amount).otherwise(0)).alias(f"{name}_{i}_{c}_{f}") for f in range(folds)]
                out.append(F.sum(F.when(there, amount).otherwise(0)).alias(f"{name}_{i}_{c}_{folds}"))
        return out

    tokens = rows.select("__f", *[f"__y{i}" for i in range(len(labels))], F.inline(token_counts(tokenize("__text", null_as=None))))
    counts = materialize(tokens.groupBy("token").agg(*split(F.col("n"), "n")))
    # what the other folds have of a token; the total (index folds) has all of them
    rest = lambda i, c, f: F.col(f"n_{i}_{c}_{folds}") - (F.col(f"n_{i}_{c}_{f}") if f < folds else 0)
    sums = []
    for i in range(len(labels)):
        for f in range(folds + 1):
            sums += [F.sum(rest(i, 1, f)).alias(f"t_{i}_1_{f}"), F.sum(rest(i, 0, f)).alias(f"t_{i}_0_{f}"),
                     F.count_if(rest(i, 1, f) + rest(i, 0, f) > 0).alias(f"v_{i}_{f}")]
    # numbers per label and fold only
    size, docs = counts.agg(*sums).first(), rows.agg(*split(F.lit(1), "d")).first()
    a = float(smoothing)
    weights, priors = [], []
    for i in range(len(labels)):
        per_fold, prior = [], []
        for f in range(folds + 1):
            mass = [(size[f"t_{i}_{c}_{f}"] or 0) + a * (size[f"v_{i}_{f}"] or 0) for c in (1, 0)]
            one, zero = rest(i, 1, f), rest(i, 0, f)
            w = F.ln((one + a) / F.lit(mass[0] or 1.0)) - F.ln((zero + a) / F.lit(mass[1] or 1.0))
            per_fold.append(F.when(one + zero > 0, w).otherwise(0.0))
            d = [(docs[f"d_{i}_{c}_{folds}"] or 0) - ((docs[f"d_{i}_{c}_{f}"] or 0) if f < folds else 0) for c in (1, 0)]
            prior.append([d[0] + 1, d[1] + 1])
        weights.append(F.array(*per_fold).alias(f"w{i}"))
        priors.append(prior)
    import math

    return BayesModel(materialize(counts.select("token", *weights)),
                      [[math.log(x / y) for x, y in p] for p in priors], labels, folds)


def bayes_scores(df: DataFrame, model: BayesModel, text: str = "reason", fold: str | Column | None = None,
                 suffix: str = "_mscore", max_broadcast_tokens: int = 2_000_000) -> DataFrame:
    """Adds ``<label><suffix>``, the probability of class 1 by the model without the row's fold.

    Without ``fold``, or where it is null, all folds count.  A null or empty text has the prior's probability.
    """
    names = [f"__s{i}" for i in range(len(model.labels))]
    at = F.lit(None).cast("int") if fold is None else (F.col(fold) if isinstance(fold, str) else fold).cast("int")
    at = F.coalesce(F.when(at.between(0, model.folds - 1), at), F.lit(model.folds))
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    keyed = df.withColumns({"__d": digest, "__f": at})
    vectors = keyed.select("__d", "__f", F.inline(token_counts(tokenize(text, null_as=None))))
    # equal texts have equal vectors: one of them is enough
    vectors = vectors.groupBy("__d", "__f", "token").agg(F.max("n").alias("n"))
    hits = vectors.join(bounded_broadcast(model.weights, max_broadcast_tokens), "token")
    sums = hits.groupBy(F.col("__d").alias("__d2"), F.col("__f").alias("__f2")) \
        .agg(*[F.sum(F.col("n") * F.get(f"w{i}", F.col("__f"))).alias(n) for i, n in enumerate(names)])
    out = keyed.join(sums, (F.col("__d") == F.col("__d2")) & (F.col("__f") == F.col("__f2")), "left")
    for i, (label, n) in enumerate(zip(model.labels, names, strict=True)):
        prior = F.get(F.array(*map(F.lit, model.priors[i])), F.col("__f"))
        s = F.greatest(F.least(prior + F.coalesce(n, F.lit(0.0)), F.lit(MAX_LOG_ODDS)), F.lit(-MAX_LOG_ODDS))
        out = out.withColumn(f"{label}{suffix}", 1.0 / (1.0 + F.exp(-s)))
    return out.drop("__d", "__f", "__d2", "__f2", *names)
