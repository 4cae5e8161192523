"""Classifier scores and score ratios (M1-M5).

M2-M5 are plain column arithmetic.  M1 runs a scorer per Arrow batch (a
pandas UDF over the text column); the Spark-native default scorer is a ``pyspark.ml``
pipeline trained on labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.numeric import nan_to_null, safe_ratio
from vigil.plans.fused import filter_project

MORAL5 = ("care_ratio", "fairness_ratio", "loyalty_ratio", "authority_ratio", "sanctity_ratio")
MORAL4 = MORAL5[:4]


def mscore_rename(df: DataFrame, suffix: str = "_mscore", to: str = "_count") -> DataFrame:
    """M2: every ``<x>_mscore`` column becomes ``<x>_count``."""
    ren = {c: c[: -len(suffix)] + to for c in df.columns if c.endswith(suffix)}
    return df.withColumnsRenamed(ren) if ren else df


def count_columns(df: DataFrame, suffix: str = "_count", exclude: Sequence[str] = ("total_count",)) -> list[str]:
    return [c for c in df.columns if c.endswith(suffix) and c not in exclude]


def row_total(df: DataFrame, cols: Sequence[str] | None = None, out: str = "total_count") -> DataFrame:
    """M3: row sum of the count columns, NULL/NaN skipped."""
    cols = list(cols) if cols is not None else count_columns(df)
    parts = [F.coalesce(nan_to_null(c), F.lit(0.0)) for c in cols]
    total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    return df.withColumn(out, total)


def row_ratio(df: DataFrame, cols: Sequence[str] | None = None, total: str = "total_count") -> DataFrame:
    """M4: ``<x>_ratio = <x>_count / total``; NULL when the total is 0."""
    cols = list(cols) if cols is not None else count_columns(df)
    return df.withColumns({c[: -len("_count")] + "_ratio": safe_ratio(c, total) for c in cols})


def ratios_from_scores(df: DataFrame, suffix: str = "_mscore") -> DataFrame:
    """M2 + M3 + M4 in order (the classifier branch of the scorer)."""
    d = mscore_rename(df, suffix)
    cols = count_columns(d)
    return row_ratio(row_total(d, cols), cols)


def renormalise(df: DataFrame, keep: Sequence[str] = MORAL4, all_parts: Sequence[str] = MORAL5) -> DataFrame:
    """M5: drop rows whose ``all_parts`` sum <= 0, then whose ``keep`` sum <= 0;
    divide the ``keep`` parts by their sum (NULL/NaN count as 0 in sums)."""
    def rsum(cols):
        parts = [F.coalesce(nan_to_null(c), F.lit(0.0)) for c in cols]
        return sum(parts[1:], parts[0])

    s4 = rsum(keep)
    # Fused so the sums are evaluated once per row (see vigil.plans.fused).
    return filter_project(df, (rsum(all_parts) > 0) & (s4 > 0), {c: nan_to_null(c) / s4 for c in keep})


# ---------------------------------------------------------------- M1

Scorer = Callable[["pd.Series"], "pd.Series"]  # noqa: F821

#: Scorers built in this Python worker, by their factory: a worker serves many tasks.
_BUILT: dict = {}


def _built(factory: Callable[[], Scorer]) -> Scorer:
    key = (getattr(factory, "__module__", ""), getattr(factory, "__qualname__", ""), pickle.dumps(getattr(factory, "args", None)))
    if key not in _BUILT:
        _BUILT[key] = factory()
    return _BUILT[key]


def classifier_scores(df: DataFrame, scorers: Mapping[str, Callable[[], Scorer]], col: str = "reason",
                      suffix: str = "_mscore") -> DataFrame:
    """M1 with injected scorers: ``scorers[name]()`` builds a function from a
    pandas Series of texts to a Series of probabilities.

    Only the text column goes through Python (an Arrow-batched pandas UDF);
    other columns keep their exact values.  A factory (a module-level function
    or a ``functools.partial`` of one) runs once per Python worker process.
    """
    names = list(scorers)
    factories = [scorers[n] for n in names]
    fields = ", ".join(f"s{i} double" for i in range(len(names)))

    @F.pandas_udf(fields)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        models = [_built(f) for f in factories]
        for texts in batches:
            yield pd.DataFrame({f"s{i}": m(texts).astype("float64").to_numpy() for i, m in enumerate(models)})

    if not names:
        return df
    out = df.withColumn("__scores", scored(F.col(col)))
    return out.withColumns({f"{n}{suffix}": F.col(f"__scores.s{i}") for i, n in enumerate(names)}).drop("__scores")


def train_text_classifiers(train: DataFrame, text_col: str, label_cols: Sequence[str],
                           num_features: int = 1 << 18, reg: float = 0.01, max_iter: int = 50) -> dict:
    """Fit one shared feature pipeline (tokenise, hash, IDF) and one logistic
    regression per label column.  Training is distributed; models are small."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    feats = Pipeline(stages=[
        RegexTokenizer(inputCol="__text", outputCol="__tok", pattern="[a-zA-Z]+", gaps=False, toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="__feat"),
    ])
    base = train.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"),
                        *[F.col(lab).cast("double").alias(lab) for lab in label_cols])
    fmodel = feats.fit(base)
    # Iterative training passes over the features many times: keep the
    # (sparse) training vectors instead of re-tokenising the text per pass.
    featured = fmodel.transform(base).select("__feat", *label_cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = {}
        for lab in label_cols:
            lr = LogisticRegression(featuresCol="__feat", labelCol=lab, probabilityCol="__prob",
                                    rawPredictionCol="__raw", predictionCol="__pred", regParam=reg,
                                    maxIter=max_iter)
            models[lab] = lr.fit(featured.where(F.col(lab).isNotNull()))
    finally:
        featured.unpersist()
    return {"features": fmodel, "models": models}


def apply_text_classifiers(df: DataFrame, trained: Mapping, text_col: str = "reason",
                           suffix: str = "_mscore") -> DataFrame:
    """M1 Spark-native: add ``<name>_mscore`` = P(class 1) for every model;
    features are computed once per row and shared by all models."""
    from pyspark.ml.functions import vector_to_array

    out = trained["features"].transform(df.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))))
    for name, model in trained["models"].items():
        # only the probability is computed
        out = model.copy().setRawPredictionCol("").setPredictionCol("").transform(out)
        out = out.withColumn(f"{name}{suffix}", vector_to_array(F.col("__prob"))[1]).drop("__prob")
    return out.drop("__text", "__tok", "__tf", "__feat")
