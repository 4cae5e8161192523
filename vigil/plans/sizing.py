"""Size checks before a table goes to the driver or into a broadcast.

A side is broadcast only when a bounded count of its rows and their bytes
proves it small; beyond the bound the caller gets the plain DataFrame and
Spark plans a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

DEFAULT_MAX_BROADCAST_ROWS = 200_000
#: Bytes of values up to which a side is broadcast, whatever its number of rows.
MAX_BROADCAST_BYTES = 128 << 20


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: 8 for a number, the length of a text, that of its JSON for a nested value."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            total = total + 8
    return total


def is_small(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes (reads at most ``max_rows`` + 1 rows)."""
    got = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(value_bytes(df)).alias("b")).first()
    return got["n"] <= max_rows and (got["b"] or 0) <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


def collect_bounded(df: DataFrame, max_rows: int) -> list | None:
    """Rows of a dimension table, or None when it exceeds ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return None if len(rows) > max_rows else [tuple(r) for r in rows]


def row_counts(dfs: list[DataFrame]) -> list[int]:
    """Exact row counts of several tables in one job."""
    if not dfs:
        return []
    u = None
    for i, df in enumerate(dfs):
        p = df.select(F.lit(i).alias("__i"))
        u = p if u is None else u.unionByName(p)
    got = {r["__i"]: r["n"] for r in u.groupBy("__i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [got.get(i, 0) for i in range(len(dfs))]
