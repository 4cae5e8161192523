"""Registered queries of runs that go on: ledgers, incremental statistics, cached grids, row accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import grid as G
from vigil.operators import increments as I
from vigil.operators.ledger import answer_jobs, job_key, join_jobs, read_ledger, respond_with_ledger
from vigil.plans import oracles as O
from vigil.plans.catalog import MORAL4, ROUTE_SQL, ROUTES, V1_COLS, _fresh, _scored_v1_sql, _stats_sql, r9, register
from vigil.plans.study import lexicon_scored_responses
from vigil.plans.stubs import stub_responder
from vigil.session import materialize
from vigil.sources import accounting as A
from vigil.sources import responses as S
from vigil.sources.fixtures import json_responses, scored_rows, small_lexicon
from vigil.sources.grid_cache import grid_by_content
from vigil.sources.tables import read_table

# ---------------------------------------------------------------- I1 with a ledger


@register("responder_ledger", f"""with v2 as ({O.V2}),
grid as (select * from (select distinct o_orderstatus as template from orders) cross join (select s_name as closeness from supplier)
         cross join (select distinct l_linenumber as severity from lineitem)),
j as (select *, '[' || template || '] ' || closeness || ' at level ' || severity as prompt from grid
      cross join (select distinct model from v2) cross join (select distinct perspective_run from v2)),
r as (select j.*, provider, 'prompt of ' || length(prompt) || ' characters' as reason from j left join (values {ROUTE_SQL}) t(model, provider) using (model))
select template, closeness, severity, model, perspective_run,
  case when provider is null then 'no provider serves the model ' || model
       else '{{"answer": "' || case when length(prompt) % 2 = 0 then 'Yes' else 'No' end || '", "reasoning": "' || reason || '"}}' end as response,
  case when provider is not null then 1 end::bigint as calls
from r""")
def q_responder_ledger(spark, sf):
    """A first run answers a part of the jobs; the second asks only the rest, and each job, whatever its rows, once."""
    t = read_table(spark, sf, "orders", ["o_orderstatus"]).distinct().withColumnRenamed("o_orderstatus", "template")
    c = read_table(spark, sf, "supplier", ["s_name"]).withColumnRenamed("s_name", "closeness")
    s = read_table(spark, sf, "lineitem", ["l_linenumber"]).distinct().withColumnRenamed("l_linenumber", "severity")
    pairs = materialize(scored_rows(spark, sf).select("model", "perspective_run").distinct())
    jobs = G.job_grid(G.factor_grid([t, c, s]), pairs.select("model").distinct(), pairs.select("perspective_run").distinct())
    asked = materialize(G.route_models(jobs, ROUTES).withColumn("prompt", F.concat(
        F.lit("["), "template", F.lit("] "), "closeness", F.lit(" at level "), F.col("severity").cast("string"))))
    ledger, low = _fresh(spark, "ledger"), F.lit("low")
    answer_jobs(asked.where("route_error is null and severity <= 2"), stub_responder, ledger, reasoning=low)
    out = respond_with_ledger(asked, stub_responder, ledger, reasoning=low, error_col="route_error")
    calls = read_ledger(spark, ledger).select("job", "calls")
    out = join_jobs(out, job_key(F.col("model"), low, F.col("prompt")), calls, asked=F.col("route_error").isNull())
    return out.select("template", "closeness", "severity", "model", "perspective_run", "response", "calls")


# ---------------------------------------------------------------- S2 + A1-A3 kept up to date


def _state_in_steps(spark, sf):
    """A state that sees runs arrive one after the other, one of them first in part, then rewritten; (cells, folders read)."""
    rows = materialize(json_responses(spark, sf))
    root, state = _fresh(spark, "runs"), _fresh(spark, "state")
    prepare = lambda d: lexicon_scored_responses(d, small_lexicon(spark), combine_runs=False)
    first = F.col("perspective_run").endswith("_1")
    read = []
    for part in (rows.where(first & (F.col("row_key") % 3 > 0)), rows.where(~first), rows.where(first)):
        S.write_responses(part, root)  # replaces the folders that it brings
        read += I.update_state(spark, root, state, prepare)
    return I.read_state(spark, root, state), read


@register("runs_state_stats", f"""with v1 as ({O.V1}), {O.EXTRACTED},
v2 as (select * from x where answer is not null and reason is not null) {_stats_sql()}""")
def q_runs_state_stats(spark, sf):
    """A1/A2 from mergeable sums: equal to one pass over all runs."""
    cells, _ = _state_in_steps(spark, sf)
    return I.stats_from_state(cells)


@register("runs_state_report", _scored_v1_sql(
    "select closeness_level, closeness_level_name, severity_level, model, perspective, "
    "round(avg(case when answer = 'Yes' then 1 else 0 end), 9) as report_ratio, "
    + ", ".join(f"round(avg({m}), 9) as {m}" for m in MORAL4) + " from scored group by all"))
def q_runs_state_report(spark, sf):
    """A3 from mergeable sums: equal to one pass over all runs."""
    cells, _ = _state_in_steps(spark, sf)
    return I.report_from_state(cells).select(*I.CELL, "model", "perspective", r9("report_ratio"), *[r9(m) for m in MORAL4])


# ---------------------------------------------------------------- S4 by content


@register("grid_by_content", """
select p_brand as vignette, r_name || case when r_regionkey = 2 then ' (new)' else '' end as closeness, severity
from (select distinct p_brand from part) cross join region cross join (select distinct l_linenumber as severity from lineitem)""")
def q_grid_by_content(spark, sf):
    """A cached grid is built anew when one level's text changes, and read when nothing does."""
    tables = {"vignette": read_table(spark, sf, "part", ["p_brand"]).distinct().withColumnRenamed("p_brand", "vignette"),
              "closeness": read_table(spark, sf, "region", ["r_regionkey", "r_name"]).withColumnRenamed("r_name", "closeness"),
              "severity": read_table(spark, sf, "lineitem", ["l_linenumber"]).distinct().withColumnRenamed("l_linenumber", "severity")}
    build = lambda t: G.factor_grid([t["vignette"], t["closeness"].drop("r_regionkey"), t["severity"]])
    root = _fresh(spark, "grids")
    grid_by_content(spark, root, tables, build)
    named = F.when(F.col("r_regionkey") == 2, F.concat("closeness", F.lit(" (new)"))).otherwise(F.col("closeness"))
    tables["closeness"] = tables["closeness"].withColumn("closeness", named)
    grid_by_content(spark, root, tables, build)
    return grid_by_content(spark, root, tables, build).select("vignette", "closeness", "severity")


# ---------------------------------------------------------------- S1 + E3, every row accounted for

BAD_TYPE, BAD_SHAPE = "row_key % 37 = 5", "row_key % 41 = 7"


@register("row_accounting", f"""with v1 as ({O.V1}), {O.EXTRACTED},
t as (select perspective_run, model, {BAD_TYPE} or {BAD_SHAPE} as bad, answer is not null and reason is not null as whole from x)
select perspective_run, model, count(*) as rows_in, count(*) filter (where not bad and whole) as kept,
  count(*) filter (where not bad and not whole) as incomplete, count(*) filter (where bad) as quarantined,
  count(*) filter (where bad) as records_set_aside
from t group by all""")
def q_row_accounting(spark, sf):
    """Files with records of a wrong type or shape: counts per run and model, and the records in the quarantine."""
    rows = json_responses(spark, sf)
    fields = [c for c in V1_COLS if c not in ("perspective_run", "model")]
    level = F.when(F.expr(BAD_TYPE), F.lit("severe")).otherwise(F.col("severity_level").cast("string")).alias("severity_level")
    line = F.to_csv(F.struct(*[level if c == "severity_level" else F.col(c) for c in fields]), {"escape": '"', "quoteAll": "true"})
    lines = rows.select("perspective_run", "model", F.when(F.expr(BAD_SHAPE), F.concat_ws(",", "row_key", "closeness_level")).otherwise(line).alias("value"))
    root, aside = _fresh(spark, "lines"), _fresh(spark, "quarantine")
    lines.sortWithinPartitions("perspective_run", "model").write.partitionBy("perspective_run", "model").text(root)
    schema = "row_key long, closeness_level int, closeness_level_name string, severity_level int, response string"
    checked = A.with_status(A.scan_checked(spark, root, schema, header=False))
    A.write_quarantine(checked, aside)
    folder = lambda name: F.regexp_extract(A.FILE, f"/{name}=([^/]*)/", 1).alias(name)
    held = spark.read.parquet(aside).groupBy(folder("perspective_run"), folder("model")).agg(F.count(A.RECORD).alias("records_set_aside"))
    return A.account(checked, "perspective_run", "model").join(held, ["perspective_run", "model"], "left") \
        .fillna(0, ["records_set_aside"])
