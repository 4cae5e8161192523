"""I1 with a durable ledger: a broken run goes on where it stopped, and equal jobs are asked once.

A job is (model, reasoning setting, prompt); its key is their SHA-256.  The ledger is a
Parquet folder of answered jobs, appended batch by batch: Spark commits a batch as a
whole, so a run that breaks loses at most the batch at hand.  The next run anti-joins
the ledger before the fan-out and calls only what is left.

Jobs are distinct by key before they are called (equal prompts of different rows cost
one call), dealt to batches by key, and answers join back by key, so prompts and
responses travel once.  With a rate, each of the tasks that run at a time gets an equal
part of it and spaces its calls accordingly.

One writer at a time: two runs on one ledger may both call a job; readers take the
answer of the latest attempt, so results stay defined.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.responder import CALLS_PER_TASK, Responder, _call
from vigil.session import materialize
from vigil.sources.responses import path_exists

LEDGER = ("job string, model string, setting string, prompt_chars long, response string, raw_response string, "
          "failed boolean, attempt int, batch int")
#: Calls of a batch, about: what a broken run repeats at most.
CALLS_PER_BATCH = 100_000


def job_key(model: Column, setting: Column, prompt: Column) -> Column:
    """SHA-256 of a job; each part is preceded by its length, a null is marked, so no two jobs share a text."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in (model, setting, prompt))).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Latest answer of every job: job, model, setting, prompt_chars, response, raw_response, failed, attempt, calls."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER).drop("batch").withColumn("calls", F.lit(0).cast("long"))
    rows = spark.read.schema(LEDGER).parquet(path)
    kept = [c for c in rows.columns if c not in ("job", "batch")]
    last = rows.groupBy("job").agg(F.max_by(F.struct(*kept), F.struct("attempt", "batch")).alias("a"), F.count(F.lit(1)).alias("calls"))
    return last.select("job", "a.*", "calls")


class _Pace:
    """Spaces the calls of a task: one every ``gap`` seconds, whichever thread makes it."""

    def __init__(self, gap: float):
        self.gap, self.at, self.lock = gap, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            start = self.at = max(now, self.at + self.gap)
        time.sleep(start - now)


def _asking(responder: Responder, concurrency: int, gap: float):
    @F.pandas_udf("raw_response string, response string, failed boolean")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pace = _Pace(gap)

        def one(job):
            pace.wait()
            failed = []

            def watched(*a):
                try:
                    return responder(*a)
                except Exception:
                    failed.append(True)
                    raise
            return (*_call(watched, job), bool(failed))

        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for model, setting, prompt in batches:
                yield pd.DataFrame(list(pool.map(one, zip(model, setting, prompt, strict=True))), columns=["raw_response", "response", "failed"])
    return ask


def answer_jobs(df: DataFrame, responder: Responder, ledger: str, prompt_col: str = "prompt", model_col: str = "model",
                reasoning: str | Column | None = None, retry_failed: bool = False, calls_per_batch: int = CALLS_PER_BATCH,
                calls_per_task: int = CALLS_PER_TASK, concurrency: int = 8, calls_per_second: float | None = None,
                after_batch: Callable[[int], None] | None = None) -> int:
    """Calls the responder for the jobs of ``df`` that the ledger lacks and appends the answers; returns the number of calls.

    ``retry_failed`` asks jobs again whose latest answer is an exception's text.
    ``after_batch(i)`` runs on the driver when batch i is in the ledger.
    """
    spark = df.sparkSession
    setting = F.lit("") if reasoning is None else F.col(reasoning) if isinstance(reasoning, str) else reasoning
    jobs = df.select(F.col(model_col).alias("model"), setting.cast("string").alias("setting"), F.col(prompt_col).alias("prompt"))
    jobs = jobs.withColumn("job", job_key(F.col("model"), F.col("setting"), F.col("prompt")))
    known = read_ledger(spark, ledger)
    answered = known.where(~F.col("failed")) if retry_failed else known
    # one row of each new job, written once: a batch that fails must not change the next ones
    todo = materialize(jobs.join(answered.select("job"), "job", "left_anti").dropDuplicates(["job"])
                       .join(known.select("job", F.col("attempt").alias("__before")), "job", "left"))
    n = todo.count()
    batches = math.ceil(n / calls_per_batch)
    cores = spark.sparkContext.defaultParallelism
    gap = min(cores, n) / calls_per_second if calls_per_second else 0.0
    ask = _asking(responder, concurrency, gap)
    for b in range(batches):
        some = todo.where(F.pmod(F.xxhash64("job"), F.lit(batches)) == b) if batches > 1 else todo
        tasks = max(cores, math.ceil(calls_per_batch / calls_per_task)) if batches > 1 else max(cores, math.ceil(n / calls_per_task))
        some = some.repartition(min(tasks, n))
        done = some.withColumn("__a", ask("model", "setting", "prompt")).select(
            "job", "model", "setting", F.length("prompt").cast("long").alias("prompt_chars"), "__a.response", "__a.raw_response", "__a.failed",
            (F.coalesce("__before", F.lit(0)) + 1).cast("int").alias("attempt"), F.lit(b).alias("batch"))
        done.write.mode("append").parquet(ledger)
        if after_batch:
            after_batch(b)
    return n


def join_jobs(df: DataFrame, key: Column, known: DataFrame, on: str = "job", asked: Column | None = None) -> DataFrame:
    """Left join with ``known`` by the job's key, which becomes the column ``on``.

    Rows where ``asked`` is false have no job: they get nulls and stay where they are.
    A join would deal all their null keys to one task.
    """
    if asked is None:
        return df.withColumn(on, key).join(known, on, "left")
    met = df.where(asked).withColumn(on, key).join(known, on, "left")
    return met.unionByName(df.where(~asked), allowMissingColumns=True)


def respond_with_ledger(df: DataFrame, responder: Responder, ledger: str, prompt_col: str = "prompt", model_col: str = "model",
                        reasoning: str | Column | None = None, error_col: str | None = None, **kw) -> DataFrame:
    """``map_responder`` through a ledger: adds ``response`` and ``raw_response``; answered jobs are not called again.

    Rows with a text in ``error_col`` are not asked; that text is their response.
    """
    keep = [c for c in df.columns if c not in ("response", "raw_response")]
    df = df.select(*keep)
    asked = df if error_col is None else df.where(F.col(error_col).isNull())
    answer_jobs(asked, responder, ledger, prompt_col, model_col, reasoning, **kw)
    setting = F.lit("") if reasoning is None else F.col(reasoning) if isinstance(reasoning, str) else reasoning
    answers = read_ledger(df.sparkSession, ledger).select(F.col("job").alias("__job"), F.col("response").alias("__r"), F.col("raw_response").alias("__raw"))
    key = job_key(F.col(model_col), setting.cast("string"), F.col(prompt_col))
    out = join_jobs(df, key, answers, "__job", None if error_col is None else F.col(error_col).isNull())
    error = F.lit(None).cast("string") if error_col is None else F.col(error_col)
    return out.select(*keep, F.coalesce(error, "__r").alias("response"), F.coalesce(error, "__raw").alias("raw_response"))
