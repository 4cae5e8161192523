"""Numeric helpers that keep pandas' missing-value rules in Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_yes(answer="answer", positive: str = "Yes") -> Column:
    """1 when the answer equals ``positive`` exactly, else 0 (NULL -> 0)."""
    return F.coalesce(_c(answer) == F.lit(positive), F.lit(False)).cast("int")


def nan_to_null(col) -> Column:
    """pandas skips NaN in means; Spark does not, so NaN becomes NULL.

    ``nanvl`` references its input once, so nested uses (ratios of sums of
    ratios) stay linear in size when Catalyst inlines them into filters.
    """
    return F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))


def safe_ratio(num, den, zero_as=None) -> Column:
    """num / den with den = 0 giving ``zero_as`` (NULL by default).

    ``try_divide`` yields NULL for a zero divisor and references ``den`` once.
    """
    q = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return q if zero_as is None else F.coalesce(q, F.lit(float(zero_as)))


def round_half_even(col, digits: int = 3) -> Column:
    """Python/numpy style rounding (ties to even)."""
    return F.bround(_c(col), digits)


# Every text that casts to a number begins like this (blanks and control characters are trimmed).
_NUMBER_START = r"(?i)^[\x00-\x20]*[+-]?(?:[0-9]|\.[0-9]|inf|nan)"


def coerce_numeric_col(col, is_text: bool = False) -> Column:
    """``to_numeric(errors='coerce')``: bad text -> NULL, NaN -> NULL.

    With ``is_text`` a cheap test comes first: a cast that fails costs an exception per row.
    """
    c = _c(col)
    number = F.when(c.rlike(_NUMBER_START), c.try_cast("double")) if is_text else c.try_cast("double")
    return nan_to_null(number)


# Fixed values of the erfc evaluation: the Maclaurin series of erf is summed
# below x = 2.5 (48 terms), the Laplace continued fraction of erfc above it
# (80 levels).  Absolute error below 5e-15 on [0, inf).
ERFC_SPLIT = 2.5
ERFC_SERIES_TERMS = 48
ERFC_CF_LEVELS = 80


def _num(v: float) -> str:
    return f"{v:.17e}"  # scientific notation: a DOUBLE literal in Spark SQL and DuckDB alike


def erfc_sql(x: str) -> str:
    """SQL text of erfc(x) for x >= 0, where ``x`` names a column.

    Arithmetic, ``exp`` and ``sqrt`` only (Spark and DuckDB have no erf), so it
    stays inside whole-stage codegen; NULL in gives NULL out.  Built as text
    and parsed once: a Column tree of this size costs a py4j call per node.
    """
    poly = _num(0.0)
    for n in range(ERFC_SERIES_TERMS - 1, -1, -1):  # Horner in x^2
        poly = f"({_num((-1) ** n / (math.factorial(n) * (2 * n + 1)))} + ({x} * {x}) * {poly})"
    frac = x
    for k in range(ERFC_CF_LEVELS, 0, -1):
        frac = f"({x} + {_num(k / 2.0)} / {frac})"
    return (f"CASE WHEN {x} < {_num(ERFC_SPLIT)} THEN {_num(1.0)} - {_num(2.0 / math.sqrt(math.pi))} * {x} * {poly} "
            f"ELSE exp(-({x} * {x})) / ({_num(math.sqrt(math.pi))} * {frac}) END")


def normal_two_sided_p(z: str) -> Column:
    """Two-sided p-value of the standard normal statistic in column ``z``:
    erfc(|z| / sqrt 2), evaluated natively."""
    x = f"(abs(`{z}`) / {_num(math.sqrt(2.0))})"
    return F.expr(erfc_sql(x))
