"""Agreement of repeated runs on the answers of a cell (nominal data).

A unit is a cell that several runs answer; its answers are compared with one another.
Krippendorff's alpha is 1 minus observed over expected disagreement:

    observed = sum over units of (m^2 - sum of n_c^2) / (m - 1)      m answers, n_c of them c
    expected = (n^2 - sum of N_c^2) / (n - 1)                        over all units with m >= 2

Counts per (unit, answer) add up map-side and all else follows from them, so answers are
never paired; work grows with the rows, and no unit or answer gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_counts(df: DataFrame, unit: Sequence[str], answer: str = "answer") -> DataFrame:
    """unit, answer and its number; null answers and units with a null key are left out."""
    return df.dropna(subset=[*unit, answer]).groupBy(*unit, answer).agg(F.count(F.lit(1)).alias("n"))


def run_agreement(df: DataFrame, keys: Sequence[str] = ("model", "perspective"),
                  cell: Sequence[str] = ("closeness_level", "severity_level"), answer: str = "answer") -> DataFrame:
    """Per ``keys``: n_units and n_answers that can be compared, n_same (units of one answer), observed and expected
    disagreement, and alpha (null where only one answer occurs)."""
    keys, cell = list(keys), list(cell)
    counts = answer_counts(df, [*keys, *cell], answer)
    n = F.col("n")
    wide = lambda c: F.col(c).cast("double")  # noqa: E731  squares of counts outgrow 64 bits
    units = counts.groupBy(*keys, *cell).agg(F.sum(n).alias("m"), F.sum(wide("n") * wide("n")).alias("squares"), F.count(F.lit(1)).alias("kinds")).where("m >= 2")
    seen = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("m").alias("n_answers"), F.count_if(F.col("kinds") == 1).alias("n_same"),
        F.sum((wide("m") * wide("m") - F.col("squares")) / (F.col("m") - 1)).alias("observed"))
    # an answer's total counts only the units that can be compared
    compared = counts.join(units.select(*keys, *cell), [*keys, *cell], "left_semi")
    totals = compared.groupBy(*keys, answer).agg(F.sum(n).alias("t")).groupBy(*keys).agg(F.sum(wide("t") * wide("t")).alias("squares"))
    out = seen.join(totals, keys)
    expected = (wide("n_answers") * wide("n_answers") - F.col("squares")) / (F.col("n_answers") - 1)
    return out.withColumn("expected", expected).withColumn("alpha", 1.0 - F.try_divide(F.col("observed"), F.col("expected"))) \
        .select(*keys, "n_units", "n_answers", "n_same", "observed", "expected", "alpha")


def coincidences(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ("model", "perspective"),
                 cell: Sequence[str] = ("closeness_level", "severity_level"), answer: str = "answer") -> DataFrame:
    """Coincidence counts per ``keys`` of each two of ``values`` (first, second, count); other answers count in no pair but in m."""
    keys, cell, values = list(keys), list(cell), list(values)
    n = [F.count_if(F.col(answer) == v).alias(f"n{i}") for i, v in enumerate(values)]
    units = df.dropna(subset=[*keys, *cell, answer]).groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("m"), *n).where("m >= 2")
    pair = lambda i, j: F.col(f"n{i}").cast("double") * (F.col(f"n{j}") - (1 if i == j else 0)) / (F.col("m") - 1)
    every = [(i, j) for i in range(len(values)) for j in range(len(values))]
    wide = units.groupBy(*keys).agg(*[F.sum(pair(i, j)).alias(f"o{i}_{j}") for i, j in every])
    rows = F.array(*[F.struct(F.lit(values[i]).alias("first"), F.lit(values[j]).alias("second"), F.col(f"o{i}_{j}").alias("count")) for i, j in every])
    return wide.select(*keys, F.inline(rows))
