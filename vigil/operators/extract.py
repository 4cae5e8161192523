"""Answer extraction, projections and filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vigil.functions.jsonx import with_answer_reason
from vigil.functions.numeric import coerce_numeric_col, is_yes
from vigil.plans.sizing import bounded_broadcast


def extract_answer_reason(df: DataFrame, col: str = "response",
                          answer: str = "answer", reason: str = "reason") -> DataFrame:
    """Add (or overwrite) ``answer`` and ``reason`` parsed from ``col``."""
    return with_answer_reason(df, col, answer, reason)


def reason_column(df: DataFrame) -> str:
    """A pre-existing ``reasoning`` column wins over the extracted ``reason``."""
    return "reasoning" if "reasoning" in df.columns else "reason"


def drop_incomplete(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Keep rows whose answer and reason column are non-null."""
    cols = list(cols) if cols is not None else ["answer", reason_column(df)]
    return df.dropna(subset=cols)


def extract_and_clean(df: DataFrame, col: str = "response") -> DataFrame:
    """E1-E4 in one call: the reference's load step after the scan."""
    reason_col = reason_column(df)
    out = extract_answer_reason(df, col)
    return out.dropna(subset=["answer", reason_col])


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """E5: bad text and NaN become NULL (``errors='coerce'``)."""
    return df.withColumns({c: coerce_numeric_col(c, isinstance(df.schema[c].dataType, StringType)) for c in cols})


def display_name(df: DataFrame, key: str, labels: DataFrame | Mapping[str, str],
                 out: str | None = None, label_key: str = "key", label_col: str = "label") -> DataFrame:
    """Map a key to a label through a small label table, falling back to the key."""
    out = out or f"{key}_display"
    if isinstance(labels, Mapping):
        pairs = [x for kv in labels.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
        m = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return df.withColumn(out, F.coalesce(F.try_element_at(m, F.col(key).cast("string")),
                                             F.col(key).cast("string")))
    # of several labels of a key the largest counts, whatever the row order
    lab = labels.groupBy(F.col(label_key).alias("__k")).agg(F.max(label_col).alias("__label"))
    j = df.join(bounded_broadcast(lab), F.col(key) == F.col("__k"), "left")
    return j.withColumn(out, F.coalesce(F.col("__label"), F.col(key).cast("string"))).drop("__k", "__label")


def answer_filter(df: DataFrame, col: str = "answer", keep: Iterable[str] = ("Yes", "No")) -> DataFrame:
    """Keep exact (case-sensitive) answers."""
    return df.where(F.col(col).isin(list(keep)))


def filter_eq(df: DataFrame, **equals) -> DataFrame:
    """Equality filter on several columns (NULL never matches)."""
    cond = F.lit(True)
    for c, v in equals.items():
        cond = cond & (F.col(c) == F.lit(v))
    return df.where(cond)


def with_is_report(df: DataFrame, answer: str = "answer", positive: str = "Yes",
                   out: str = "is_report") -> DataFrame:
    """0/1 indicator, NULL answer -> 0."""
    return df.withColumn(out, is_yes(answer, positive))


def project_order(df: DataFrame, first: Iterable[str] = ("model", "perspective")) -> DataFrame:
    """Put ``first`` columns first, keep the rest in order."""
    first = [c for c in first if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])
