"""Filter-and-project evaluated once per row.

Catalyst pushes a filter below the projections that define the columns it
tests, substituting their full expressions.  For derived columns built from
other derived columns (ratios of sums of ratios) the pushed condition becomes
very large, is generated as one huge method that the JVM does not compile, and
is evaluated again in the projection.  Emitting the kept row from a
one-element-or-empty generator evaluates the condition and the new columns
once, in a compact compiled plan; the optimizer does not rewrite it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_project(df: DataFrame, condition: Column, columns: Mapping[str, Column]) -> DataFrame:
    """Rows where ``condition`` is true, with ``columns`` added or replaced."""
    names = list(columns)
    out = F.struct(*[columns[n].alias(n) for n in names])
    out_type = df.select(out.alias("__o")).schema["__o"].dataType
    keep = [F.col(c) for c in df.columns if c not in names]
    rows = F.when(F.coalesce(condition, F.lit(False)), F.array(out)).otherwise(
        F.array().cast(f"array<{out_type.simpleString()}>"))
    g = df.select(*keep, F.inline(rows))
    # input column order, replaced columns in place, new ones at the end
    return g.select(*df.columns, *[n for n in names if n not in df.columns])
