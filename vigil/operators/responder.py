"""Apply a text -> text responder to every prompt.

The responder is injected (a picklable callable ``(model, reasoning, prompt)
-> (raw_response, response)``).  Only the texts it needs go through Python, as
an Arrow-batched pandas UDF; all other columns stay in the JVM untouched, so
keys of any type keep their exact values.  Inside a batch a thread pool keeps
``concurrency`` calls in flight.  An exception becomes the response text of
its row, never a failed task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Responder = Callable[[str, str, str], tuple]

#: Calls that one task makes at most, about: what a lost task repeats.
CALLS_PER_TASK = 2_000


def _call(responder: Responder, args) -> tuple:
    try:
        raw, text = responder(*args)
        return None if raw is None else str(raw), None if text is None else str(text)
    except Exception as e:  # noqa: BLE001 - the error text is the row's response
        return str(e), str(e)


def map_responder(df: DataFrame, responder: Responder, prompt_col: str = "prompt", model_col: str = "model",
                  reasoning: str | Column | None = None, error_col: str | None = None, concurrency: int = 8,
                  calls_per_task: int = CALLS_PER_TASK) -> DataFrame:
    """Adds ``response`` and ``raw_response``.

    ``reasoning``: column (or its name) with the reasoning setting, empty by
    default.  ``error_col`` (as ``route_models`` makes it): where it is not null
    its text is the response and nothing is called.

    Calls are slow per row, so prompts are dealt round-robin over the cluster's
    default parallelism, or over more tasks if there are more than
    ``calls_per_task`` prompts for each; never over fewer than they come in.
    """
    n = df.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / calls_per_task))
    if df.rdd.getNumPartitions() < tasks:
        df = df.repartition(max(1, min(tasks, n)))

    @F.pandas_udf("raw_response string, response string")
    def respond(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for model, setting, prompt in batches:
                got = list(pool.map(lambda a: _call(responder, a), zip(model, setting, prompt)))
                yield pd.DataFrame(got, columns=["raw_response", "response"])

    setting = F.lit("") if reasoning is None else F.col(reasoning) if isinstance(reasoning, str) else reasoning
    keep = [c for c in df.columns if c not in ("response", "raw_response", "__answer")]
    if error_col is None:
        called = df
        failed = None
    else:
        called, failed = df.where(F.col(error_col).isNull()), df.where(F.col(error_col).isNotNull())
    out = called.withColumn("__answer", respond(F.col(model_col), setting, F.col(prompt_col))) \
        .select(*keep, F.col("__answer.response").alias("response"), F.col("__answer.raw_response").alias("raw_response"))
    if failed is not None:
        text = F.col(error_col)
        out = out.unionByName(failed.select(*keep, text.alias("response"), text.alias("raw_response")))
    return out
