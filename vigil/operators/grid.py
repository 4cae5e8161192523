"""Factorial prompt grids, sampling and job fan-out.

A grid is the product of level tables.  A table is broadcast only if its
counted size allows; the product is dealt over as many tasks as its rows need.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.hashing import unit_hash
from vigil.functions.text import render_template as _render
from vigil.plans.sizing import bounded_broadcast, row_counts
from vigil.session import materialize

#: Rows up to which a level table is broadcast; a larger one is crossed or joined by shuffling.
MAX_BROADCAST_LEVELS = 1_000_000


ROWS_PER_TASK = 1_000_000


def cross_product(tables: Sequence[DataFrame], counts: Sequence[int], fan_out: float = 1,
                  rows_per_task: int = ROWS_PER_TASK, broadcast_rows: int = MAX_BROADCAST_LEVELS) -> DataFrame:
    """Product of level tables (``counts`` are their row counts).

    Crossing broadcast tables streams the first one, so one task would emit
    the whole product.  Instead the first tables are crossed until they hold
    enough rows, dealt round-robin over ceil(rows / ``rows_per_task``) tasks,
    and the remaining tables are broadcast into that spread side; a table above
    ``broadcast_rows`` is crossed without a broadcast.  ``fan_out`` is what
    later joins multiply each row by.
    """
    total = max(1.0, fan_out)
    for c in counts:
        total *= max(c, 1)
    parts = max(1, math.ceil(total / rows_per_task))

    def side(k: int) -> DataFrame:
        return F.broadcast(tables[k]) if counts[k] <= broadcast_rows else tables[k]

    out, running, i = tables[0], max(counts[0], 1), 1
    while parts > 1 and running < parts and i < len(tables):
        out = out.crossJoin(side(i))
        running *= max(counts[i], 1)
        i += 1
    if parts > 1:
        out = out.repartition(min(parts, running))
    for k in range(i, len(tables)):
        out = out.crossJoin(side(k))
    return out


def factor_grid(factors: Sequence[DataFrame], nested: Sequence[tuple[DataFrame, Sequence[str]]] = (),
                max_rows: int | None = None) -> DataFrame:
    """Product of independent ``factors``; each ``nested`` table is a
    child factor joined on its parent key(s) (levels that depend on a parent).

    The size is not limited unless the caller sets ``max_rows``; then the
    grid's exact number of rows is counted first and a larger one raises.
    """
    # Level tables are small: each is written once to the shared checkpoint
    # folder, so its size check and the grid read the copy instead of scanning
    # (and de-duplicating) its source twice.
    factors = [materialize(f) for f in factors]
    nested = [(materialize(c), list(on)) for c, on in nested]
    # one job counts all level tables and, for children, their parents
    sizes = row_counts([*factors, *[c for c, _ in nested], *[c.select(*on).distinct() for c, on in nested]])
    n, m = len(factors), len(nested)
    fan_out = 1.0
    for rows, parents in zip(sizes[n:n + m], sizes[n + m:]):
        fan_out *= rows / max(parents, 1)  # children per parent
    grid = cross_product(factors, sizes[:n], fan_out=fan_out)
    for (child, on), rows in zip(nested, sizes[n:n + m]):
        grid = grid.join(F.broadcast(child) if rows <= MAX_BROADCAST_LEVELS else child, on, "inner")
    if max_rows is not None and (size := grid.count()) > max_rows:
        raise ValueError(f"grid of {size} rows exceeds max_rows={max_rows}")
    return grid


def render_prompts(grid: DataFrame, template_col: str, mapping: Mapping[str, str | Column],
                   out: str = "prompt") -> DataFrame:
    """Fill ``{name}`` fields of the template in one pass per row."""
    return grid.withColumn(out, _render(F.col(template_col), {k: (F.col(v) if isinstance(v, str) else v)
                                                            for k, v in mapping.items()}))


def unknown_keys(df: DataFrame, known: DataFrame | Sequence[str], on: str) -> DataFrame:
    """G4 helper: distinct values of ``df[on]`` missing from ``known`` (anti join)."""
    if not isinstance(known, DataFrame):
        known = df.sparkSession.createDataFrame([(k,) for k in known], f"{on} string")
    k = known.select(on).distinct()
    return df.select(on).distinct().join(bounded_broadcast(k, MAX_BROADCAST_LEVELS), on, "left_anti")


def validate_keys(df: DataFrame, known: DataFrame | Sequence[str], on: str) -> DataFrame:
    """Raise when ``df[on]`` holds a value that ``known`` lacks."""
    bad = unknown_keys(df, known, on).limit(5).collect()
    if bad:
        raise ValueError(f"unknown {on}: {[r[0] for r in bad]}")
    return df


#: Ranges of hashes that a sample counts; a range holds a 16,384th of the rows.
HASH_RANGES = 1 << 14


def sample_n(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | str = (),
             method: str = "xxhash64") -> DataFrame:
    """Exactly ``n`` rows without replacement when ``0 < n < rows``,
    chosen by the smallest hash of (seed, key); the whole table otherwise.

    Deterministic in (seed, key), independent of partitioning.  The input is evaluated
    twice: for the counts of hash ranges, and for the candidates, which are written.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if not keys:
        raise ValueError("sample_n needs a key that identifies rows")
    if n <= 0:
        return df
    d = df.withColumn("__u", unit_hash(seed, *keys, method=method))
    # first pass: rows per range of hashes, a table of bounded size
    rows = d.groupBy(F.floor(F.col("__u") * HASH_RANGES).cast("int").alias("r")).agg(F.count(F.lit(1)).alias("c")).orderBy("r").collect()
    below, last = 0, None
    for r in rows:
        if below + r["c"] >= n:
            last = r
            break
        below += r["c"]
    if last is None or (last is rows[-1] and below + last["c"] == n):
        return df
    # second pass: the ranges that the n smallest hashes lie in, written once, so the cut does not evaluate the input again
    cand = materialize(d.where(F.col("__u") < F.lit((last["r"] + 1) / HASH_RANGES)))
    if below + last["c"] == n:
        return cand.drop("__u")
    # the last range's rows in order give the largest (hash, key) that is in
    order = ["__u", *keys]
    cut = cand.where(F.col("__u") >= F.lit(last["r"] / HASH_RANGES)).select(*order).orderBy(*order).limit(n - below) \
        .orderBy(*[F.col(c).desc() for c in order]).first()
    within = F.lit(True)  # (u, keys) <= cut, lexicographically
    for c in reversed(order):
        x = F.lit(cut[c]).cast(cand.schema[c].dataType)
        within = (F.col(c) < x) | ((F.col(c) == x) & within)
    return cand.where(within).drop("__u")


def job_grid(grid: DataFrame, models: DataFrame, runs: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every model x every run x every prompt, as one distributed table.

    Prompts are dealt over enough tasks that none emits more than about
    ``rows_per_task`` jobs.
    """
    models, runs = materialize(models), materialize(runs)
    n_models, n_runs, n_grid = row_counts([models, runs, grid])
    jobs = cross_product([models, runs], [n_models, n_runs])
    parts = math.ceil(n_grid * n_models * n_runs / rows_per_task)
    if parts > 1:
        grid = grid.repartition(min(parts, max(1, n_grid)))
    return grid.crossJoin(F.broadcast(jobs) if n_models * n_runs <= MAX_BROADCAST_LEVELS else jobs)


def route_models(df: DataFrame, routes: DataFrame | Mapping[str, str], model: str = "model",
                 out: str = "provider") -> DataFrame:
    """Provider for each model through a broadcast route table; an
    unknown model gets NULL provider and an error text in ``route_error``."""
    if isinstance(routes, Mapping):
        routes = df.sparkSession.createDataFrame(list(routes.items()), f"{model} string, {out} string")
    # of several routes of a model the largest name counts, whatever the row order
    r = routes.groupBy(model).agg(F.max(out).alias(out))
    j = df.join(bounded_broadcast(r, MAX_BROADCAST_LEVELS), model, "left")
    err = F.when(F.col(out).isNull(), F.concat(F.lit("no provider serves the model "), F.col(model)))
    return j.withColumn("route_error", err)
