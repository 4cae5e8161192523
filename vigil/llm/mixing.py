"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a budget of words.  Whole passes over the source cover most
of it; what is left (less than one pass) is filled by documents taken once
more.  Which ones is decided on the histogram of exact document sizes: every
size class gives the same share of its documents, and what that rounding
leaves over is fitted by a bounded-knapsack dynamic program over the documents
that remain in each class.  A rest too long for the program is first rounded in
proportion: the fractions of neighbouring classes add up to whole documents, so no
length is preferred, and the program always decides the end.  The documents of a class are then drawn by a
seeded hash.  Only the histogram (one row per source and size) is ever grouped
by source; documents are ranked in hash buckets of bounded size, so a source
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans.sizing import bounded_broadcast
from vigil.session import materialize

#: The dynamic program decides at least so many words of a rest, and two documents of the longest size.
WINDOW_WORDS = 1 << 16
#: Documents ranked together in one hash bucket of a (source, size) class.
BUCKET_ROWS = 2_000

PLAN_SCHEMA = ("source string, size long, n_docs long, extra long, epochs long, source_size long, "
               "target double, buckets long")
PLAN_VALUES = ("extra", "epochs", "source_size", "target", "buckets")


def water_fill(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets by weight that no source exceeds ``cap`` times its size with.

    ``sources``: one row per source with ``source_size`` and ``weight``.  The
    budget is ``share`` times all sizes.  Each round fixes the sources whose
    part by weight passes their cap and shares the excess among the others; it
    ends when none is above.  A round is one aggregate; only two sums reach the
    driver.  Adds ``target`` (0 for an empty source; if ``share`` is at least
    ``cap`` every source gets its cap).
    """
    budget = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    full = F.lit(float(cap)) * F.col("source_size")
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > full
        got = sources.agg(F.sum(F.when(above, full).otherwise(0.0)).alias("fixed"),
                          F.sum(F.when(above, 0.0).otherwise(F.col("weight").cast("double"))).alias("open")).first()
        if not got["open"]:
            break
        nxt = (budget - got["fixed"]) / got["open"]
        if nxt <= level:
            break
        level = nxt
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), full))


def fit_lengths(sizes: np.ndarray, counts: np.ndarray, budget: float, window: int = WINDOW_WORDS) -> np.ndarray:
    """How many documents of each size to take so that their words come nearest to ``budget``.

    Every class first gives ``floor(count * budget / total)`` documents.  While more
    than ``window`` words (and two of the longest documents) are undecided, the classes'
    fractions are rounded in proportion: from the longest size down, a class gives one
    more document when the fractions up to it have added up to one.  A
    bounded knapsack over the remaining counts then finds the reachable sum nearest to
    what is open (ties: the smaller); its table has five bytes for each word of twice that.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if total <= 0 or budget <= 0:
        return take
    if budget >= total:
        return np.where(sizes > 0, counts, 0)
    use = sizes > 0
    take[use] = np.floor(counts[use] * (budget / total)).astype(np.int64)
    rest = budget - float((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    keep = max(window, 2 * int(sizes[use].max()))
    part = np.where(use, counts * (budget / total) - take, 0.0)  # of a document
    open_words = part * sizes
    undecided, carry = rest, 0.5
    for i in order:  # neighbours differ little, so the words given stay within a document of the words due
        if undecided <= keep:
            break
        undecided -= open_words[i]
        carry += part[i]
        if carry >= 1.0 and counts[i] > take[i]:
            take[i] += 1
            carry -= 1.0
            rest -= float(sizes[i])
    if rest <= 0:
        return take
    left = counts - take
    items = [int(i) for i in order if sizes[i] > 0 and left[i] > 0]
    if not items:
        return take
    top = min(int(2 * rest) + 1, int(sum(sizes[i] * left[i] for i in items)))  # beyond this, taking nothing is nearer
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    by = np.full(top + 1, -1, np.int32)
    goal = int(round(rest))
    for i in items:
        size, have = int(sizes[i]), int(left[i])
        if size > top:
            continue
        if have <= 2:  # one or two documents: plain shifts
            for again in range(have):
                new = np.zeros(top + 1, bool)
                new[size:] = reach[:-size]
                new &= ~reach
                if again:  # a second document extends only sums that hold the first
                    new[size:] &= by[:-size] == i
                by[new] = i
                reach |= new
        else:
            width = -(-(top + 1) // size) * size
            grid = np.zeros(width, bool)
            grid[:top + 1] = reach
            grid = grid.reshape(-1, size)
            row = np.arange(len(grid))[:, None]
            last = np.maximum.accumulate(np.where(grid, row, -(1 << 40)), axis=0)
            new = ((row - last <= have) & ~grid).reshape(-1)[:top + 1]
            by[new] = i
            reach |= new
        if goal <= top and reach[goal]:
            break
    sums = np.flatnonzero(reach)
    s = int(sums[np.lexsort((sums, np.abs(sums - rest)))[0]])
    while s > 0:
        i = int(by[s])
        take[i] += 1
        s -= int(sizes[i])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", ignore_index=True)
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    epochs = int(min(target // total, target / total + 1e-12)) if total > 0 else 0
    budget = target - epochs * total
    extra = fit_lengths(pdf["size"].to_numpy(np.int64), pdf["n_docs"].to_numpy(np.int64), budget)
    return pdf.assign(extra=extra, epochs=epochs,
                      buckets=np.maximum(1, -(-pdf["n_docs"] // BUCKET_ROWS)))[
        ["source", "size", "n_docs", "extra", "epochs", "source_size", "target", "buckets"]]


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, pattern: tuple[int, ...] = (5, 2, 1),
                share: float = 1.5, cap: float = 2.0, seed: int = 7, tie: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Word counts that a mix of all sources takes from every document.

    ``docs``: columns ``source`` (string, null is a source of its own), ``size``
    (long, null counts as 0) and those of ``tie``; further columns are kept.
    ``weights``: (source, weight); without it the sources by code point, null
    last, weigh ``pattern`` in turn.  Adds ``source_size`` (long), ``target``
    (double), ``copies`` (times the document is read) and ``taken`` (``copies *
    size``).  ``size`` and ``source`` must not depend on the run: the same rows
    give the same mix.  Column names that begin with two underscores are reserved;
    extra columns named like an output are replaced.

    Defined cases: an empty table gives an empty result; a source without words
    has target 0; documents without words are never drawn for the rest (they
    are read in whole passes, taking 0 words); rows that agree in ``tie`` and
    size are interchangeable, so which of them is drawn is left open.
    """
    from vigil.operators.report import global_row_number

    docs = docs.withColumn("size", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")))
    hist = materialize(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n_docs")))
    per = materialize(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n_docs")).alias("source_size")))
    if weights is None:
        ranked = global_row_number(per, [F.col("source").asc_nulls_last()], "__r")
        turn = F.array(*[F.lit(float(w)) for w in pattern])
        per = ranked.withColumn("weight", F.element_at(turn, ((F.col("__r") - 1) % len(pattern) + 1).cast("int"))).drop("__r")
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        per = per.join(w, per["source"].eqNullSafe(w["__s"]), "left").drop("__s").fillna(0.0, ["weight"])
    per = water_fill(materialize(per), share, cap).select(F.col("source").alias("__s"), "source_size", "target")
    plan = hist.join(bounded_broadcast(per), hist["source"].eqNullSafe(F.col("__s"))).drop("__s")
    plan = materialize(plan.groupBy("source").applyInPandas(_fit_source, PLAN_SCHEMA))
    small = bounded_broadcast(plan.select(F.col("source").alias("__s"), F.col("size").alias("__z"),
                                          *[F.col(c).alias(f"__{c}") for c in PLAN_VALUES]))
    h = F.xxhash64(F.lit(seed), F.col("size"), *[F.col(c) for c in tie])
    rows = docs.join(small, docs["source"].eqNullSafe(F.col("__s")) & (docs["size"] == F.col("__z"))) \
        .drop("__s", "__z").withColumn("__h", h)
    # the hash's order is cut into equal buckets of about BUCKET_ROWS documents
    rows = rows.withColumn("__b", F.least(
        F.floor((F.col("__h").cast("double") / F.lit(2.0 ** 64) + 0.5) * F.col("__buckets")), F.col("__buckets") - 1))
    key = ["source", "size", "__b"]
    before = Window.partitionBy("source", "size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = rows.where(F.col("__buckets") > 1).groupBy(*key).agg(F.count(F.lit(1)).alias("__c")) \
        .select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("__b").alias("__bb"),
                F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("__h", *tie))
    out = rows.withColumn("__rank", rank)
    out = out.join(bounded_broadcast(materialize(offs)), out["source"].eqNullSafe(F.col("__s"))
                   & (out["size"] == F.col("__z")) & (out["__b"] == F.col("__bb")), "left")
    more = (F.coalesce("__off", F.lit(0)) + F.col("__rank") <= F.col("__extra")).cast("long")
    out = out.withColumns({"source_size": F.col("__source_size"), "target": F.col("__target"),
                           "copies": F.col("__epochs") + more})
    return out.withColumn("taken", F.col("copies") * F.col("size")) \
        .drop("__h", "__b", "__rank", "__s", "__z", "__bb", "__off", *[f"__{c}" for c in PLAN_VALUES])
