"""Registered queries: one per operator, each paired with DuckDB SQL when the
operator is expressible in SQL.  Every query reads the driver tables (or data
Spark derives from them) in full.

Averages are rounded to 9 decimals on both sides: summation order differs
between engines and value hashes are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import extract as X
from vigil.operators import lexicon as L
from vigil.operators import rates as R
from vigil.plans import oracles as O
from vigil.plans.study import lexicon_scored_responses, with_perspective
from vigil.session import materialize
from vigil.sources.fixtures import json_responses, scored_rows, small_lexicon
from vigil.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def r9(c, alias=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 9)
    return col.alias(alias or (c if isinstance(c, str) else None))


MORAL4 = ["care_ratio", "fairness_ratio", "loyalty_ratio", "authority_ratio"]
CATS = O.CATS

# ---------------------------------------------------------------- extraction


@register("extract_json", f"""
with v1 as ({O.V1}), {O.EXTRACTED}
select row_key, answer, reason from x""")
def q_extract_json(spark, sf):
    return X.extract_answer_reason(json_responses(spark, sf)).select("row_key", "answer", "reason")


@register("reason_fallback", f"""
with v1 as ({O.V1}), {O.EXTRACTED}
select answer, cast(count(*) as bigint) as n_rows, cast(count(reason) as bigint) as n_reason,
       cast(coalesce(sum(length(reason)), 0) as bigint) as reason_chars
from x group by answer""")
def q_reason_fallback(spark, sf):
    x = X.extract_answer_reason(json_responses(spark, sf))
    return x.groupBy("answer").agg(F.count(F.lit(1)).alias("n_rows"), F.count("reason").alias("n_reason"),
                                   F.coalesce(F.sum(F.length("reason")), F.lit(0)).cast("long").alias("reason_chars"))


@register("drop_incomplete", f"""
with v1 as ({O.V1}), {O.EXTRACTED}
select row_key, model, perspective_run, answer, cast(length(reason) as int) as reason_chars
from x where answer is not null and reason is not null""")
def q_drop_incomplete(spark, sf):
    kept = X.drop_incomplete(X.extract_answer_reason(json_responses(spark, sf)))
    return kept.select("row_key", "model", "perspective_run", "answer",
                       F.length("reason").cast("int").alias("reason_chars"))


@register("choose_reason_col", f"""
with v1 as (select *, nullif(regexp_extract(response, 'reasoning', 0), '') as reasoning from ({O.V1})), {O.EXTRACTED}
select row_key, answer, reasoning from x where answer is not null and reasoning is not null""")
def q_choose_reason_col(spark, sf):
    v1 = json_responses(spark, sf).withColumn(
        "reasoning", F.nullif(F.regexp_extract("response", "reasoning", 0), F.lit("")))
    kept = X.extract_and_clean(v1)  # E4: the existing 'reasoning' column decides
    return kept.select("row_key", "answer", "reasoning")


@register("coerce_numeric", """
select event_id,
  case when isnan(try_cast(cast(value as varchar) as double)) then null
       else try_cast(cast(value as varchar) as double) end as value,
  case when isnan(try_cast(props as double)) then null else try_cast(props as double) end as props,
  case when isnan(try_cast(event_type as double)) then null else try_cast(event_type as double) end as event_type
from events""")
def q_coerce_numeric(spark, sf):
    ev = read_table(spark, sf, "events", ["event_id", "value", "props", "event_type"])
    ev = ev.withColumn("value", F.col("value").cast("string"))
    return X.coerce_numeric(ev, ["value", "props", "event_type"])


MODEL_LABELS = {"m0": "Model Zero", "m1": "Model One", "m2": "Model Two", "m3": "Model Three"}


def _labels_sql():
    rows = ", ".join(f"('{k}', '{v}')" for k, v in MODEL_LABELS.items())
    return f"(select * from (values {rows}) as t(key, label))"


def _stats_sql():
    return f"""
select model, regexp_replace(perspective_run, '_[123]$', '') as perspective,
  round_even(count(*) / 1296e0, 3) as response_rate,
  round_even(avg(case when answer = 'Yes' then 1 else 0 end), 3) as overall_yes_ratio,
  round_even(avg(case when closeness_level = 1 and severity_level = 4
                      then (case when answer = 'Yes' then 1 else 0 end) end), 3) as closeness1_severity4_yes_ratio,
  round_even(avg(case when closeness_level = 4 and severity_level = 1
                      then (case when answer = 'Yes' then 1 else 0 end) end), 3) as closeness4_severity1_yes_ratio
from v2 group by all"""


@register("display_name", f"""
with v2 as ({O.V2}), st as ({_stats_sql()})
select st.*, coalesce(l.label, st.model) as model_display from st left join {_labels_sql()} l on st.model = l.key""")
def q_display_name(spark, sf):
    st = R.stats_by_model_perspective(scored_rows(spark, sf))
    labels = spark.createDataFrame(list(MODEL_LABELS.items()), "key string, label string")
    return X.display_name(st, "model", labels, out="model_display")


@register("answer_filter", f"""
with v2 as ({O.V2}) select row_key, answer from v2 where answer in ('Yes', 'No')""")
def q_answer_filter(spark, sf):
    return X.answer_filter(scored_rows(spark, sf)).select("row_key", "answer")


@register("filter_eq", f"""
with v2 as ({O.V2}) select row_key, model, perspective, answer from v2 where model = 'm1' and perspective = 'F'""")
def q_filter_eq(spark, sf):
    return X.filter_eq(scored_rows(spark, sf), model="m1", perspective="F") \
        .select("row_key", "model", "perspective", "answer")


@register("is_report", f"""
with v2 as ({O.V2}) select row_key, case when answer = 'Yes' then 1 else 0 end as is_report from v2""")
def q_is_report(spark, sf):
    return X.with_is_report(scored_rows(spark, sf)).select("row_key", "is_report")


@register("project_order", f"with v2 as ({O.V2}) {_stats_sql()}")
def q_project_order(spark, sf):
    return X.project_order(R.stats_by_model_perspective(scored_rows(spark, sf)))


# ---------------------------------------------------------------- lexicon

# The ten categories that part sizes are mapped onto for the
# lexicon built from part names (category = CATS[p_size % 10]).
def _part_lexicon(spark, sf):
    p = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_size"])
    words = p.select("p_partkey", "p_size", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    cat = F.element_at(F.array(*[F.lit(c) for c in CATS]), (F.col("p_size") % 10 + 1).cast("int"))
    tok = F.when(F.col("p_partkey") % 2 == 1, F.initcap("word")).otherwise(F.col("word"))
    return words.select(tok.alias("token"), cat.alias("category"),
                        (F.col("p_partkey") * 8 + F.col("pos")).alias("ordinal"))


def _part_lexicon_sql():
    cats = ", ".join(f"'{c}'" for c in CATS)
    return f"""(select case when p_partkey % 2 = 1 then upper(word[1]) || lower(word[2:]) else word end as token,
        ([{cats}])[p_size % 10 + 1] as category, p_partkey * 8 + pos - 1 as ordinal
     from (select p_partkey, p_size, unnest(string_split(p_name, ' ')) as word,
                  generate_subscripts(string_split(p_name, ' '), 1) as pos from part))"""


@register("lexicon_map", f"""
select lower(token) as token, arg_max(category, ordinal) as category from {_part_lexicon_sql()} group by 1""")
def q_lexicon_map(spark, sf):
    return L.lexicon_map(_part_lexicon(spark, sf))


@register("tokenize", """
select doc_id, cast(len(t) as int) as n_tokens, cast(len(list_distinct(t)) as int) as n_distinct,
       cast(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) as bigint) as token_chars
from (select doc_id, regexp_extract_all(lower(text), '[a-zA-Z]+') as t from documents)""")
def q_tokenize(spark, sf):
    from vigil.functions.text import tokenize
    d = read_table(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"),
                    F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("token_chars"))


def _doc_counts_sql(stop_rowside: bool, select: str) -> str:
    return f"""
with {O.lex_map_sql(False)}, {O.per_row_counts_sql('documents', 'doc_id', 'text', stop_rowside)}
select d.doc_id, {select} from documents d left join cnt using (doc_id)"""


def _counts_select(prefix="cnt."):
    return ", ".join(f"cast(coalesce({prefix}\"{c.replace('.', '_')}_count\", 0) as bigint) as {c.replace('.', '_')}_count"
                     for c in CATS)


def _doc_scores(spark, sf, stopwords=None):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return L.lexicon_scores(d, small_lexicon(spark), col="text", stopwords=stopwords)


@register("lexicon_counts", _doc_counts_sql(False, _counts_select()))
def q_lexicon_counts(spark, sf):
    s = _doc_scores(spark, sf)
    return s.select("doc_id", *[f"{c.replace('.', '_')}_count" for c in CATS])


def _word_lexicon(spark, sf):
    """Every distinct token of the documents, with a category by its length: a lexicon that grows with the corpus."""
    words = L.distinct_tokens(read_table(spark, sf, "documents", ["text"]), "text")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATS]), F.length("token") % len(CATS) + 1)
    return words.select("token", cat.alias("category"), F.lit(1).alias("ordinal"))


LARGE_LEXICON_SQL = f"""
with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, 'nan')), '[a-zA-Z]+')) as token from documents),
cnt as (select doc_id, {', '.join(f"count(*) filter (length(token) % 10 = {i}) as c{i}" for i in range(10))} from t group by doc_id)
select d.doc_id, {', '.join(f"coalesce(c{i}, 0)::bigint as {c.replace('.', '_')}_count" for i, c in enumerate(CATS))}
from documents d left join cnt using (doc_id)"""


def _large_counts(spark, sf, **kw):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    s = L.lexicon_scores(d, materialize(_word_lexicon(spark, sf)), col="text", categories=CATS, stopwords=None, strategy="join", **kw)
    return s.select("doc_id", *[f"{c.replace('.', '_')}_count" for c in CATS])


@register("lexicon_counts_large", LARGE_LEXICON_SQL)
def q_lexicon_counts_large(spark, sf):
    """The joined plan, with a lexicon above any size that is put into the plan as literals."""
    return _large_counts(spark, sf)


@register("lexicon_counts_filtered", LARGE_LEXICON_SQL)
def q_lexicon_counts_filtered(spark, sf):
    """The joined plan for a lexicon above the broadcast bound: a bounded hash filter, then a shuffle join."""
    return _large_counts(spark, sf, max_broadcast_tokens=0)


@register("remove_stopwords", _doc_counts_sql(True, _counts_select()))
def q_remove_stopwords(spark, sf):
    s = _doc_scores(spark, sf, stopwords="english")
    return s.select("doc_id", *[f"{c.replace('.', '_')}_count" for c in CATS])


def _ratio_select(names):
    return ", ".join(
        f"round(coalesce(cnt.\"{n}_count\", 0) / greatest(coalesce(cnt.matched, 0), 1), 9) as {n}_ratio" for n in names)


@register("lexicon_ratios", _doc_counts_sql(False, _ratio_select([c.replace('.', '_') for c in CATS])))
def q_lexicon_ratios(spark, sf):
    s = _doc_scores(spark, sf)
    return s.select("doc_id", *[r9(f"{c.replace('.', '_')}_ratio") for c in CATS])


def _foundation_select():
    parts = []
    for f in O.FOUNDATIONS:
        s = " + ".join(f"coalesce(cnt.\"{c.replace('.', '_')}_count\", 0)" for c in CATS if c.startswith(f + "."))
        parts.append(f"cast({s} as bigint) as {f}_count")
        parts.append(f"round(({s}) / greatest(coalesce(cnt.matched, 0), 1), 9) as {f}_ratio")
    return ", ".join(parts)


@register("foundation_rollup", _doc_counts_sql(False, _foundation_select()))
def q_foundation_rollup(spark, sf):
    s = _doc_scores(spark, sf)
    cols = []
    for f in O.FOUNDATIONS:
        cols += [F.col(f"{f}_count"), r9(f"{f}_ratio")]
    return s.select("doc_id", *cols)


@register("lexicon_probe", f"""
with {O.lex_map_sql(False)},
toks as (select unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) as token from documents)
select category, cast(count(*) as bigint) as n_hits from toks join lexs using (token) group by category""")
def q_lexicon_probe(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    hits = L.token_category_hits(d, small_lexicon(spark), "text", "doc_id", stopwords=None)
    return hits.groupBy("category").agg(F.count(F.lit(1)).alias("n_hits"))


def _scored_v1_sql(select_tail: str) -> str:
    return f"""
with v1 as ({O.V1}), {O.EXTRACTED},
kept as (select * from x where answer is not null and reason is not null),
{O.lex_map_sql(False)}, {O.per_row_counts_sql('kept', 'row_key', 'response', True)},
scored as (select kept.*, regexp_replace(perspective_run, '_[123]$', '') as perspective,
  {O.score_select_sql('cnt.')}
  from kept left join cnt using (row_key))
{select_tail}"""


def _scored_v1(spark, sf):
    return lexicon_scored_responses(json_responses(spark, sf), small_lexicon(spark))


@register("attach_scores", _scored_v1_sql(
    "select row_key, answer, perspective, " + ", ".join(
        [f"{c.replace('.', '_')}_count" for c in CATS] + [f"{f}_count" for f in O.FOUNDATIONS]
        + [f"round({f}_ratio, 9) as {f}_ratio" for f in O.FOUNDATIONS]) + " from scored"))
def q_attach_scores(spark, sf):
    s = _scored_v1(spark, sf)
    return s.select("row_key", "answer", "perspective",
                    *[f"{c.replace('.', '_')}_count" for c in CATS], *[f"{f}_count" for f in O.FOUNDATIONS],
                    *[r9(f"{f}_ratio") for f in O.FOUNDATIONS])


# ---------------------------------------------------------------- rates


@register("yes_ratios", f"""
with v2 as ({O.V2})
select round_even(count(*) / 1296e0, 3) as response_rate,
  round_even(avg(case when answer = 'Yes' then 1 else 0 end), 3) as overall_yes_ratio,
  round_even(avg(case when closeness_level = 1 and severity_level = 4
                      then (case when answer = 'Yes' then 1 else 0 end) end), 3) as closeness1_severity4_yes_ratio,
  round_even(avg(case when closeness_level = 4 and severity_level = 1
                      then (case when answer = 'Yes' then 1 else 0 end) end), 3) as closeness4_severity1_yes_ratio
from v2""")
def q_yes_ratios(spark, sf):
    return R.yes_ratios(scored_rows(spark, sf))


@register("stats_by_model_perspective", f"with v2 as ({O.V2}) {_stats_sql()}")
def q_stats(spark, sf):
    return R.stats_by_model_perspective(scored_rows(spark, sf))


@register("report_ratio", _scored_v1_sql(
    "select closeness_level, closeness_level_name, severity_level, model, perspective, "
    "round(avg(case when answer = 'Yes' then 1 else 0 end), 9) as report_ratio, "
    + ", ".join(f"round(avg({m}), 9) as {m}" for m in MORAL4) + " from scored group by all"))
def q_report_ratio(spark, sf):
    rr = R.report_ratio(_scored_v1(spark, sf))
    return rr.select(*R.REPORT_KEYS, r9("report_ratio"), *[r9(m) for m in MORAL4])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum slice: responses -> answers -> lexicon scores -> report ratios."""
    return q_report_ratio(spark, sf)


# ---------------------------------------------------------------- classifier ratios, summaries

from vigil.operators import classify as M  # noqa: E402
from vigil.operators import report as P  # noqa: E402
from vigil.functions.text import strip_run_suffix  # noqa: E402

SCORE5 = ["care", "fairness", "loyalty", "authority", "sanctity"]
MORAL5 = [f"{s}_ratio" for s in SCORE5]

V2R = f"""v2 as ({O.V2}),
v2t as (select *, {' + '.join(f'coalesce({s}_count, 0)' for s in SCORE5)} as total_count from v2),
v2q as (select *, {', '.join(f'{s}_count / nullif(total_count, 0) as {s}_ratio' for s in SCORE5)} from v2t)"""

CELLS = f"""{V2R},
cells as (select closeness_level, closeness_level_name, severity_level, model, perspective,
  avg(case when answer = 'Yes' then 1 else 0 end) as report_ratio,
  {', '.join(f'avg({m}) as {m}' for m in MORAL4)}
  from v2q group by all)"""


def _v2_ratios(spark, sf):
    return M.row_ratio(M.row_total(scored_rows(spark, sf)))


def _cells(spark, sf):
    # The cell table (one row per closeness x severity x model x perspective)
    # feeds medians, clusters and densities that read it several times:
    # aggregate the source once and keep the small result in the shared folder.
    return materialize(R.report_ratio(_v2_ratios(spark, sf)))


@register("mscore_rename", f"with v2 as ({O.V2}) select row_key, {', '.join(f'{s}_count' for s in SCORE5)} from v2")
def q_mscore_rename(spark, sf):
    v2 = scored_rows(spark, sf)
    as_classifier = v2.withColumnsRenamed({f"{s}_count": f"{s}_mscore" for s in SCORE5})
    return M.mscore_rename(as_classifier).select("row_key", *[f"{s}_count" for s in SCORE5])


@register("row_total", f"with {V2R} select row_key, round(total_count, 9) as total_count from v2q")
def q_row_total(spark, sf):
    return M.row_total(scored_rows(spark, sf)).select("row_key", r9("total_count"))


@register("row_ratio", f"with {V2R} select row_key, {', '.join(f'round({m}, 9) as {m}' for m in MORAL5)} from v2q")
def q_row_ratio(spark, sf):
    return _v2_ratios(spark, sf).select("row_key", *[r9(m) for m in MORAL5])


@register("renormalise", f"""with {V2R},
f as (select * from v2q where {' + '.join(f'coalesce({m}, 0)' for m in MORAL5)} > 0
                        and {' + '.join(f'coalesce({m}, 0)' for m in MORAL4)} > 0)
select row_key, {', '.join(f"round({m} / ({' + '.join(f'coalesce({k}, 0)' for k in MORAL4)}), 9) as {m}" for m in MORAL4)}
from f""")
def q_renormalise(spark, sf):
    return M.renormalise(_v2_ratios(spark, sf)).select("row_key", *[r9(m) for m in MORAL4])


@register("profile_means", f"""with {V2R}
select model, perspective, {', '.join(f'round(avg({m}), 9) as {m}' for m in MORAL4)} from v2q group by all""")
def q_profile_means(spark, sf):
    pm = R.profile_means(_v2_ratios(spark, sf))
    return pm.select("model", "perspective", *[r9(m) for m in MORAL4])


@register("group_median_rows", f"""with {V2R}
select perspective, round(median(care_ratio), 9) as median from v2q where care_ratio is not null group by perspective""")
def q_group_median_rows(spark, sf):
    """Medians over all rows, many of them tied."""
    return R.group_median(_v2_ratios(spark, sf), keys=["perspective"], col="care_ratio").select("perspective", r9("median"))


@register("group_median", f"""with {CELLS}
select model, perspective, round(quantile_cont(report_ratio, 0.5), 9) as median from cells group by all""")
def q_group_median(spark, sf):
    return R.group_median(_cells(spark, sf)).select("model", "perspective", r9("median"))


@register("pivot_matrix", f"""with {CELLS},
piv as (select model, perspective, severity_level,
  {', '.join(f'avg(report_ratio) filter (where closeness_level = {c}) as c{c}' for c in (1, 2, 3, 4))}
  from cells group by all),
skel as (select * from (select distinct model from cells) cross join (select distinct perspective from cells)
         cross join (select distinct severity_level from cells))
select skel.model, skel.perspective, skel.severity_level, {', '.join(f'round(c{c}, 9) as c{c}' for c in (1, 2, 3, 4))}
from skel left join piv using (model, perspective, severity_level)""")
def q_pivot_matrix(spark, sf):
    pv = P.pivot_matrix(_cells(spark, sf))
    return pv.select("model", "perspective", "severity_level", *[r9(f"c{c}") for c in (1, 2, 3, 4)])


GAP_SQL = f"""{CELLS},
med as (select model, perspective, quantile_cont(report_ratio, 0.5) as median from cells group by all),
g as (select *, median - lag(median) over (partition by model order by median, perspective) as gap from med),
cl as (select model, perspective, median,
  cast(sum(case when gap is null or gap <= 0.035 then 0 else 1 end)
       over (partition by model order by median, perspective rows between unbounded preceding and current row) as int)
  as cluster from g)"""


def _clusters(spark, sf):
    return P.gap_clusters(R.group_median(_cells(spark, sf)), keys=["model"], value="median")


@register("gap_clusters", f"with {GAP_SQL} select model, perspective, round(median, 9) as median, cluster from cl")
def q_gap_clusters(spark, sf):
    return _clusters(spark, sf).select("model", "perspective", r9("median"), "cluster")


PRIORITY = {"F": 0, "O": 1}


@register("cluster_anchor", f"""with {GAP_SQL},
pr as (select *, case perspective when 'F' then 0 when 'O' then 1 else 999 end as priority from cl)
select model, perspective, cluster, priority,
  count(*) over (partition by model, cluster) as cluster_size,
  round(avg(median) over (partition by model, cluster), 9) as cluster_mean,
  cast(row_number() over (partition by model, cluster order by priority, perspective) as int) as member_rank
from pr""")
def q_cluster_anchor(spark, sf):
    ca = P.cluster_anchor(_clusters(spark, sf), keys=["model"], priority=PRIORITY)
    return ca.select("model", "perspective", "cluster", "priority", "cluster_size", r9("cluster_mean"),
                     "member_rank")


@register("model_order", f"""with v2 as ({O.V2}), st as ({_stats_sql()}),
b as (select model, avg(overall_yes_ratio) as score from st where perspective = 'F' group by model)
select model, score, cast(row_number() over (order by score desc nulls last, model) as int) as rank from b""")
def q_model_order(spark, sf):
    return R.model_order(R.stats_by_model_perspective(scored_rows(spark, sf)), first="F")


@register("order_models", f"""with v2 as ({O.V2}), st as ({_stats_sql()}),
b as (select model, round(avg(overall_yes_ratio), 9) as score from st group by model)
select model, score, cast(row_number() over (order by score desc nulls last, model) as int) as rank from b""")
def q_order_models(spark, sf):
    mo = R.model_order(R.stats_by_model_perspective(scored_rows(spark, sf)))
    return mo.select("model", r9("score"), "rank")


@register("level_names", f"""with v2 as ({O.V2})
select closeness_level, min(closeness_level_name) as closeness_level_name from v2
where closeness_level is not null and closeness_level_name is not null group by 1""")
def q_level_names(spark, sf):
    return R.level_names(scored_rows(spark, sf))


@register("dense_skeleton", f"""with v2 as ({O.V2}),
vals as (select model, perspective_run, count(*) as n from v2
         where answer = 'Yes' and care_count = 0 and closeness_level = 1 group by all),
skel as (select * from (select distinct model from v2 where model is not null)
         cross join (select distinct perspective_run from v2 where perspective_run is not null))
select skel.model, skel.perspective_run, cast(coalesce(n, 0) as bigint) as n
from skel left join vals using (model, perspective_run)""")
def q_dense_skeleton(spark, sf):
    v2 = scored_rows(spark, sf)
    # One pass: conditional counts over every observed (model, run) pair; the
    # skeleton then adds the pairs that never occur together.
    cond = (F.col("answer") == "Yes") & (F.col("care_count") == 0) & (F.col("closeness_level") == 1)
    vals = v2.groupBy("model", "perspective_run").agg(F.count_if(cond).alias("n"))
    return P.dense_skeleton(vals, [["model"], ["perspective_run"]], fill={"n": 0}, materialize=True)


@register("sorted_keys", f"""with v2 as ({O.V2})
select distinct perspective_run from v2 where perspective_run is not null""")
def q_sorted_keys(spark, sf):
    return R.sorted_keys(scored_rows(spark, sf), "perspective_run")


ORDER_LIST = ["P", "X", "F", "O", "Z"]


@register("membership", f"""with v2 as ({O.V2}),
lst as (select * from (values {', '.join(f"('{v}', {i + 1})" for i, v in enumerate(ORDER_LIST))}) t(perspective, order_pos))
select perspective, order_pos from lst where perspective in (select perspective from v2)""")
def q_membership(spark, sf):
    return P.membership(scored_rows(spark, sf), "perspective", ORDER_LIST)


@register("explicit_order", f"""with v2 as ({O.V2}), st as ({_stats_sql()})
select st.*, cast(case perspective when 'P' then 1 when 'F' then 2 when 'O' then 3 end as int) as order_pos from st""")
def q_explicit_order(spark, sf):
    return P.explicit_order(R.stats_by_model_perspective(scored_rows(spark, sf)), "perspective", ["P", "F", "O"])


@register("head_n", f"""with v2 as ({O.V2}), st as ({_stats_sql()})
select * from st order by overall_yes_ratio desc, model, perspective limit 5""")
def q_head_n(spark, sf):
    st = R.stats_by_model_perspective(scored_rows(spark, sf))
    return P.head_n(st, 5, [F.col("overall_yes_ratio").desc(), "model", "perspective"])


@register("union_runs", f"""with v1 as ({O.V1}), {O.EXTRACTED}, v2 as ({O.V2})
select * from (select cast(row_key as varchar) as row_key, model, perspective_run, answer,
                      cast(length(reason) as double) as reason_chars from x where answer is not null and reason is not null)
union all by name
select * from (select row_key, model, perspective_run, answer, care_count from v2)""")
def q_union_runs(spark, sf):
    a = X.extract_and_clean(json_responses(spark, sf)).select(
        F.col("row_key").cast("string").alias("row_key"), "model", "perspective_run", "answer",
        F.length("reason").cast("double").alias("reason_chars"))
    b = scored_rows(spark, sf).select("row_key", "model", "perspective_run", "answer", "care_count")
    return P.union_runs([a, b])


@register("strip_run_suffix", f"""with v1 as ({O.V1}), v2 as ({O.V2}),
runs as (select perspective_run from v1 union select perspective_run from v2)
select perspective_run, regexp_replace(perspective_run, '_[123]$', '') as perspective from runs""")
def q_strip_run_suffix(spark, sf):
    runs = json_responses(spark, sf).select("perspective_run").union(
        scored_rows(spark, sf).select("perspective_run")).distinct()
    return runs.withColumn("perspective", strip_run_suffix("perspective_run"))


# ---------------------------------------------------------------- grid and inference fan-out


from vigil.functions.text import short_model_name  # noqa: E402
from vigil.operators import grid as G  # noqa: E402
from vigil.operators.responder import map_responder  # noqa: E402
from vigil.plans.stubs import stub_responder  # noqa: E402

GRID_SQL = r"""
t as (select distinct o_orderstatus as template from orders),
cl as (select r_regionkey + 1 as closeness_level, r_name as closeness_level_name from region),
ex as (select n_regionkey + 1 as closeness_level, n_nationkey as closeness_level_example_n,
              n_name as closeness_level_example_name from nation),
vc as (select p_type as violation_category_name,
              cast(row_number() over (order by p_type) as int) as violation_category
       from (select distinct p_type from part)),
vg as (select distinct p_type as violation_category_name, p_brand as vignette_name,
              cast(regexp_extract(p_brand, '\d+') as int) as vignette from part),
sv as (select distinct l_linenumber as severity_level from lineitem),
grid as (select * from t cross join cl join ex using (closeness_level)
         cross join vc join vg using (violation_category_name) cross join sv)"""

GRID_COLS = ["template", "closeness_level", "closeness_level_name", "closeness_level_example_n",
             "closeness_level_example_name", "violation_category", "violation_category_name", "vignette",
             "vignette_name", "severity_level"]

# Fixed value: the template pattern the grid queries render ({{ }} are literal braces).
TEMPLATE_TEXT = ('] The depot of {closeness} holds {violation} in stock. '
                 'Is another delivery due? Reply as {{"answer": "Yes or No", "reasoning": "why"}}')


def _grid(spark, sf):
    t = read_table(spark, sf, "orders", ["o_orderstatus"]).distinct().withColumnRenamed("o_orderstatus", "template")
    cl = read_table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("closeness_level"),
                                                F.col("r_name").alias("closeness_level_name"))
    ex = read_table(spark, sf, "nation").select((F.col("n_regionkey") + 1).alias("closeness_level"),
                                                F.col("n_nationkey").alias("closeness_level_example_n"),
                                                F.col("n_name").alias("closeness_level_example_name"))
    types = read_table(spark, sf, "part", ["p_type"]).distinct()
    vc = P.global_row_number(types, ["p_type"], "violation_category") \
        .withColumnRenamed("p_type", "violation_category_name")
    vg = read_table(spark, sf, "part", ["p_type", "p_brand"]).distinct().select(
        F.col("p_type").alias("violation_category_name"), F.col("p_brand").alias("vignette_name"),
        F.regexp_extract("p_brand", r"\d+", 0).cast("int").alias("vignette"))
    sv = read_table(spark, sf, "lineitem", ["l_linenumber"]).distinct() \
        .withColumnRenamed("l_linenumber", "severity_level")
    g = G.factor_grid([t, cl, vc, sv], nested=[(ex, ["closeness_level"]), (vg, ["violation_category_name"])])
    return g.select(*GRID_COLS)


def _rendered(spark, sf):
    g = _grid(spark, sf).withColumn("template_text", F.concat(F.lit("["), F.col("template"), F.lit(TEMPLATE_TEXT)))
    return G.render_prompts(g, "template_text", {"closeness": "closeness_level_example_name",
                                                 "violation": "vignette_name"}).drop("template_text")


RENDER_SQL = f"""{GRID_SQL},
r as (select *, replace(replace(replace(replace(replace(replace(
        concat('[', template, '{TEMPLATE_TEXT}'), '{{{{', chr(1)), '}}}}', chr(2)),
        '{{closeness}}', closeness_level_example_name), '{{violation}}', vignette_name), chr(1), '{{'), chr(2), '}}')
      as prompt from grid)"""


@register("factor_grid", f"with {GRID_SQL} select {', '.join(GRID_COLS)} from grid")
def q_factor_grid(spark, sf):
    return _grid(spark, sf)


@register("cross_dims", f"""with {GRID_SQL}
select template, closeness_level, cast(count(*) as bigint) as n_rows,
       cast(count(distinct closeness_level_example_n) as bigint) as n_examples from grid group by all""")
def q_cross_dims(spark, sf):
    return _grid(spark, sf).groupBy("template", "closeness_level").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("closeness_level_example_n").alias("n_examples"))


@register("render_template", f"with {RENDER_SQL} select {', '.join(GRID_COLS)}, prompt from r")
def q_render_template(spark, sf):
    return _rendered(spark, sf)


@register("validate_template", f"""with v1 as ({O.V1})
select distinct regexp_replace(perspective_run, '_[123]$', '') as perspective from v1
where regexp_replace(perspective_run, '_[123]$', '') not in ('p', 'd')""")
def q_validate_template(spark, sf):
    runs = json_responses(spark, sf).select(strip_run_suffix("perspective_run").alias("perspective"))
    return G.unknown_keys(runs, ["p", "d"], "perspective")


@register("sample_n", f"""with v2 as ({O.V2})
select row_key, model, answer from v2
order by ('0x' || substr(md5(concat_ws('|', '42', row_key)), 1, 8))::UBIGINT / 4294967296.0, row_key limit 100""")
def q_sample_n(spark, sf):
    return G.sample_n(scored_rows(spark, sf), 100, seed=42, key="row_key", method="md5") \
        .select("row_key", "model", "answer")


LARGE_SAMPLE_ROWS = 20_000


@register("sample_n_large", f"""with v2 as ({O.V2})
select row_key, model, answer from v2
order by ('0x' || substr(md5(concat_ws('|', '7', row_key)), 1, 8))::UBIGINT / 4294967296.0, row_key limit {LARGE_SAMPLE_ROWS}""")
def q_sample_n_large(spark, sf):
    return G.sample_n(scored_rows(spark, sf), LARGE_SAMPLE_ROWS, seed=7, key="row_key", method="md5") \
        .select("row_key", "model", "answer")


@register("job_grid", f"""with {GRID_SQL}, v2 as ({O.V2}),
n as (select count(*) as n from grid)
select model, perspective_run, cast(n as bigint) as n_prompts
from (select distinct model from v2) cross join (select distinct perspective_run from v2) cross join n""")
def q_job_grid(spark, sf):
    # both lists come from one pass over the rows
    pairs = materialize(scored_rows(spark, sf).select("model", "perspective_run").distinct())
    jobs = G.job_grid(_grid(spark, sf), pairs.select("model").distinct(), pairs.select("perspective_run").distinct())
    return jobs.groupBy("model", "perspective_run").agg(F.count(F.lit(1)).alias("n_prompts"))


@register("map_responder", f"""with {RENDER_SQL}
select {', '.join(GRID_COLS)}, 'stub/model-a' as model,
  case when contains(prompt, 'Brand#13') then 'stub responder: request rejected'
       else '{{"answer": "' || case when length(prompt) % 2 = 0 then 'Yes' else 'No' end
            || '", "reasoning": "prompt of ' || cast(length(prompt) as varchar) || ' characters"}}' end as response
from r""")
def q_map_responder(spark, sf):
    prompts = _rendered(spark, sf).withColumn("model", F.lit("stub/model-a"))
    out = map_responder(prompts, stub_responder, concurrency=8)
    return out.select(*GRID_COLS, "model", "response")


ROUTES = {"m0": "router", "m1": "router", "m2": "direct", "m3": "direct"}


@register("route_models", f"""with v2 as ({O.V2}),
r as (select * from (values {', '.join(f"('{k}', '{v}')" for k, v in ROUTES.items())}) t(model, provider))
select m.model, r.provider, case when r.provider is null then 'no provider serves the model ' || m.model end as route_error
from (select distinct model from v2) m left join r using (model)""")
def q_route_models(spark, sf):
    return G.route_models(scored_rows(spark, sf).select("model").distinct(), ROUTES)


@register("short_model_name", f"""with v2 as ({O.V2}),
m as (select distinct 'org/' || model as model_id, case when model in ('m0', 'm1') then 'high' else '' end as reasoning
      from v2)
select model_id, reasoning,
  case when reasoning = '' then split_part(model_id, '/', -1) else split_part(model_id, '/', -1) || '_' || reasoning end
  as short_name from m""")
def q_short_model_name(spark, sf):
    m = scored_rows(spark, sf).select(
        F.concat(F.lit("org/"), F.col("model")).alias("model_id"),
        F.when(F.col("model").isin("m0", "m1"), F.lit("high")).otherwise(F.lit("")).alias("reasoning")).distinct()
    return m.withColumn("short_name", short_model_name("model_id", "reasoning"))


# ---------------------------------------------------------------- regression, bootstrap, density

from vigil.functions.hashing import mix32_sql_ctes, poisson1_weight_sql  # noqa: E402
from vigil.operators import bootstrap as B  # noqa: E402
from vigil.operators.density import grouped_kde  # noqa: E402
from vigil.operators.regression import normal_quantile, ols_hc3  # noqa: E402

N_BOOT = 800


RENORM_SQL = f"""{V2R},
rn as (select model, perspective, closeness_level, severity_level,
  {', '.join(f"{m} / ({' + '.join(f'coalesce({k}, 0)' for k in MORAL4)}) as {m}" for m in MORAL4)}
  from v2q where {' + '.join(f'coalesce({m}, 0)' for m in MORAL5)} > 0
             and {' + '.join(f'coalesce({m}, 0)' for m in MORAL4)} > 0)"""


@register("ols_hc3", f"""with {RENORM_SQL},
{O.ols_hc3_sql('rn', ['model', 'perspective'], MORAL4, "closeness_level", "severity_level", normal_quantile(0.95))}
select model, perspective, moral, term, round(coef, 9) as coef, round(se, 9) as se, round(ci_low, 9) as ci_low,
       round(ci_high, 9) as ci_high, round(p, 9) as p, n from ols""")
def q_ols_hc3(spark, sf):
    fit = ols_hc3(M.renormalise(_v2_ratios(spark, sf)))
    return fit.select("model", "perspective", "moral", "term", *[r9(c) for c in ("coef", "se", "ci_low", "ci_high", "p")],
                      "n")


def _boot_sql(src: str, keys: list[str], cols: list[str], seed: int = 0, n_boot: int = N_BOOT) -> str:
    """Long bootstrap result (keys, metric, mean, ci95_low, ci95_high, n) as CTEs ending in 'boot'."""
    ks = ", ".join(keys)
    hseed = f"('0x' || substr(md5(concat_ws('|', '{seed}', row_key)), 1, 8))::UBIGINT"
    mix_ctes, mixed = mix32_sql_ctes("fan", "mx")
    pts = ", ".join(f"avg({c}) as p{i}, count({c}) as n{i}" for i, c in enumerate(cols))
    reps = ", ".join(f"sum(w * {c}) / nullif(sum(case when {c} is not null then w end), 0) as r{i}"
                     for i, c in enumerate(cols))
    cis = ", ".join(f"quantile_cont(r{i}, [0.025, 0.975]) as c{i}" for i in range(len(cols)))
    longs = " union all ".join(
        f"select {ks}, '{c}' as metric, case when n{i} > 0 then p{i} end as mean, "
        f"case when n{i} > 0 then c{i}[1] end as ci95_low, case when n{i} > 0 then c{i}[2] end as ci95_high, "
        f"cast(n{i} as bigint) as n from pt left join ci using ({ks})" for i, c in enumerate(cols))
    return f"""
pt as (select {ks}, {pts} from {src} group by {ks}),
fan as (select {ks}, {', '.join(cols)}, {hseed} as h, b from {src} s, generate_series(0, {n_boot - 1}) g(b)),
{mix_ctes},
wt as (select *, {poisson1_weight_sql('u')} as w from {mixed}),
reps as (select {ks}, b, {reps} from wt group by {ks}, b),
ci as (select {ks}, {cis} from reps group by {ks}),
boot as ({longs})"""


def _round_boot(df):
    return df.withColumns({c: F.round(c, 9) for c in ("mean", "ci95_low", "ci95_high")})


@register("bootstrap_ci", f"""with {V2R}, {_boot_sql('v2q', ['perspective'], MORAL4)}
select perspective, metric, round(mean, 9) as mean, round(ci95_low, 9) as ci95_low,
       round(ci95_high, 9) as ci95_high, n from boot""")
def q_bootstrap_ci(spark, sf):
    res = B.bootstrap_ci(_v2_ratios(spark, sf), ["perspective"], MORAL4, "row_key", n_boot=N_BOOT, seed=0)
    return _round_boot(res)


YESNO_PERSPECTIVES = ["F", "O", "P", "X"]

YESNO_SQL = f"""{V2R},
yn as (select * from v2q where answer in ('Yes', 'No') and perspective in ('F', 'O', 'P', 'X')),
{_boot_sql('yn', ['perspective', 'answer'], MORAL4)},
pers as (select distinct perspective,
           cast(case perspective when 'F' then 0 when 'O' then 1 when 'P' then 2 when 'X' then 3 end as int)
           as perspective_pos from yn),
ans as (select * from (values ('Yes', 0), ('No', 1)) t(answer, answer_pos)),
met as (select * from (values {', '.join(f"('{m}', '{B.default_metric_names([m])[m]}', {i})" for i, m in enumerate(MORAL4))})
        t(metric, metric_name, metric_pos)),
summary as (select pers.perspective, ans.answer, met.metric, met.metric_name, boot.mean, boot.ci95_low,
                   boot.ci95_high, coalesce(boot.n, 0) as n, perspective_pos, answer_pos, metric_pos
            from pers cross join ans cross join met
            left join boot on boot.perspective = pers.perspective and boot.answer = ans.answer
                          and boot.metric = met.metric)"""


def _summary(spark, sf):
    return B.yesno_summary(_v2_ratios(spark, sf), perspectives=YESNO_PERSPECTIVES, n_boot=N_BOOT, seed=0)


@register("yesno_summary", f"""with {YESNO_SQL}
select perspective, answer, metric, metric_name, round(mean, 9) as mean, round(ci95_low, 9) as ci95_low,
       round(ci95_high, 9) as ci95_high, n, perspective_pos, answer_pos, metric_pos from summary""")
def q_yesno_summary(spark, sf):
    return _round_boot(_summary(spark, sf))


def _boot_median_sql(src: str, keys: list[str], col: str, seed: int, n_boot: int) -> str:
    """CTEs ending in 'boot': median of the rows and of weighted replicates, per key."""
    ks = ", ".join(keys)
    hseed = f"('0x' || substr(md5(concat_ws('|', '{seed}', row_key)), 1, 8))::UBIGINT"
    mix_ctes, mixed = mix32_sql_ctes("fan", "mx")
    return f"""
pt as (select {ks}, median({col}) as median, count({col}) as n from {src} group by {ks}),
fan as (select {ks}, {col} as v, {hseed} as h, b from {src} s, generate_series(0, {n_boot - 1}) g(b) where {col} is not null),
{mix_ctes},
tied as (select {ks}, b, v, sum({poisson1_weight_sql('u')}) as w from {mixed} group by {ks}, b, v),
cum as (select *, sum(w) over (partition by {ks}, b order by v) as upto, sum(w) over (partition by {ks}, b) as total from tied where w > 0),
reps as (select {ks}, b, (min(v) filter (where upto > floor((total - 1) / 2)) + min(v) filter (where upto > ceil((total - 1) / 2))) / 2 as r
         from cum group by {ks}, b),
ci as (select {ks}, quantile_cont(r, [0.025, 0.975]) as c from reps group by {ks}),
boot as (select {ks}, '{col}' as metric, median, c[1] as ci95_low, c[2] as ci95_high, n::bigint as n from pt left join ci using ({ks}))"""


N_BOOT_MEDIAN = 100


def _round_median(df):
    return df.withColumns({c: F.round(c, 9) for c in ("median", "ci95_low", "ci95_high")})


@register("bootstrap_median", f"""with {V2R}, {_boot_median_sql('v2q', ['perspective'], 'care_ratio', 3, N_BOOT_MEDIAN)}
select perspective, metric, round(median, 9) as median, round(ci95_low, 9) as ci95_low, round(ci95_high, 9) as ci95_high, n from boot""")
def q_bootstrap_median(spark, sf):
    return _round_median(B.bootstrap_ci(_v2_ratios(spark, sf), ["perspective"], ["care_ratio"], "row_key", n_boot=N_BOOT_MEDIAN,
                                        seed=3, stat="median"))


@register("yesno_summary_median", f"""with {V2R}, yn as (select * from v2q where answer in ('Yes', 'No')),
{_boot_median_sql('yn', ['perspective', 'answer'], 'care_ratio', 0, N_BOOT_MEDIAN)}
select p.perspective, a.answer, 'care_ratio' as metric, 'Care' as metric_name, round(median, 9) as median,
  round(ci95_low, 9) as ci95_low, round(ci95_high, 9) as ci95_high, coalesce(n, 0) as n
from (select distinct perspective from yn) p cross join (values ('Yes'), ('No')) a(answer)
left join boot on boot.perspective = p.perspective and boot.answer = a.answer""")
def q_yesno_summary_median(spark, sf):
    s = B.yesno_summary(_v2_ratios(spark, sf), metrics=["care_ratio"], n_boot=N_BOOT_MEDIAN, seed=0, stat="median")
    return _round_median(s).select("perspective", "answer", "metric", "metric_name", "median", "ci95_low", "ci95_high", "n")


@register("axis_limits", f"""with {YESNO_SQL}
select round(greatest(0.0, min(ci95_low) - 0.03), 9) as y_min, round(least(1.0, max(ci95_high) + 0.03), 9) as y_max
from summary""")
def q_axis_limits(spark, sf):
    lim = P.axis_limits(_summary(spark, sf))
    return lim.select(r9("y_min"), r9("y_max"))


@register("error_bars", f"""with {YESNO_SQL}
select perspective, metric,
  round(max(case when answer = 'Yes' then mean end), 9) as yes_mean,
  round(max(case when answer = 'Yes' then mean - ci95_low end), 9) as yes_err_low,
  round(max(case when answer = 'Yes' then ci95_high - mean end), 9) as yes_err_high,
  round(max(case when answer = 'No' then mean end), 9) as no_mean,
  round(max(case when answer = 'No' then mean - ci95_low end), 9) as no_err_low,
  round(max(case when answer = 'No' then ci95_high - mean end), 9) as no_err_high
from summary group by all""")
def q_error_bars(spark, sf):
    eb = P.error_bars(_summary(spark, sf))
    return eb.select("perspective", "metric", *[r9(c) for c in eb.columns if c not in ("perspective", "metric")])


@register("grouped_kde", f"""with {CELLS},
st as (select model, perspective, count(report_ratio) as n, stddev_samp(report_ratio) as sd,
              min(report_ratio) as vmin, max(report_ratio) as vmax
       from cells where report_ratio is not null group by all),
st2 as (select *, sd * pow(cast(n as double), -0.2) as bw from st where n >= 2 and sd > 0),
st3 as (select *, vmin - 2.0 * bw as lo, ((vmax + 2.0 * bw) - (vmin - 2.0 * bw)) / 199.0 as step from st2),
vals as (select model, perspective, report_ratio as v, count(*) as c from cells
         where report_ratio is not null group by all),
g as (select st3.*, v, c, cast(point as int) as point
      from vals join st3 using (model, perspective) cross join generate_series(0, 199) t(point))
select model, perspective, point, round(lo + point * step, 9) as x,
       round(sum(c * exp(-0.5 * ((lo + point * step - v) / bw) * ((lo + point * step - v) / bw)))
             * (1.0 / sqrt(2.0 * pi())) / (n * bw), 9) as density
from g group by model, perspective, point, lo, step, n, bw""")
def q_grouped_kde(spark, sf):
    k = grouped_kde(_cells(spark, sf))
    return k.select("model", "perspective", "point", r9("x"), r9("density"))


# ---------------------------------------------------------------- sources and sinks, classifier

import uuid  # noqa: E402

from functools import partial  # noqa: E402

from vigil.operators.bayes import bayes_scores, fit_bayes  # noqa: E402
from vigil.operators.classify import classifier_scores  # noqa: E402
from vigil.plans.stubs import length_scorer  # noqa: E402
from vigil.session import scratch_path  # noqa: E402
from vigil.sources import responses as S  # noqa: E402
from vigil.sources.lexicon import read_dic_lexicon, write_dic_lexicon  # noqa: E402

V1_SCHEMA = ("row_key long, model string, perspective_run string, closeness_level int, "
             "closeness_level_name string, severity_level int, response string")
V1_COLS = ["row_key", "model", "perspective_run", "closeness_level", "closeness_level_name",
           "severity_level", "response"]


def _fresh(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("scan_responses", f"with v1 as ({O.V1}) select * from v1")
def q_scan_responses(spark, sf):
    path = _fresh(spark, "responses-csv")
    json_responses(spark, sf).write.options(header="true", quote='"', escape='"').csv(path)
    return S.scan_responses(spark, path, schema=V1_SCHEMA, fmt="csv").select(*V1_COLS)


@register("scan_all_runs", f"""with v1 as ({O.V1})
select *, regexp_replace(perspective_run, '_[123]$', '') as perspective from v1""")
def q_scan_all_runs(spark, sf):
    root = _fresh(spark, "runs")
    S.write_responses(json_responses(spark, sf), root, fmt="csv")
    schema = "row_key long, closeness_level int, closeness_level_name string, severity_level int, response string"
    df = S.scan_all_runs(spark, root, fmt="csv", layout="hive", schema=schema, combine_runs=True)
    return df.select(*V1_COLS, "perspective")


@register("sink_responses", f"""with v1 as ({O.V1}), {O.EXTRACTED}
select row_key, model, perspective_run, answer, reason from x where answer is not null and reason is not null""")
def q_sink_responses(spark, sf):
    root = _fresh(spark, "extracted")
    kept = X.extract_and_clean(json_responses(spark, sf)).select("row_key", "model", "perspective_run",
                                                                 "answer", "reason")
    S.write_responses(kept, root)
    return spark.read.parquet(root).select("row_key", "model", "perspective_run", "answer", "reason")


@register("csv_round_trip", f"""with v1 as ({O.V1})
select row_key, '0' || substr(model, 2) as model, perspective_run, '  ' || response || ' " , ' as response,
  cast(length(response) + 7 as int) as response_chars from v1""")
def q_csv_round_trip(spark, sf):
    """Texts keep their outer white space and model names their leading zeros through the CSV sink and scan."""
    root = _fresh(spark, "csv-runs")
    rows = json_responses(spark, sf).select("row_key", F.concat(F.lit("0"), F.substring("model", 2, 9)).alias("model"),
                                            "perspective_run", F.concat(F.lit("  "), "response", F.lit(' " , ')).alias("response"))
    S.write_responses(rows, root, fmt="csv")
    back = S.scan_all_runs(spark, root, fmt="csv", schema="row_key long, response string")
    return back.select("row_key", "model", "perspective_run", "response", F.length("response").alias("response_chars"))


@register("runs_to_stats", f"""with v1 as ({O.V1}), {O.EXTRACTED},
v2 as (select * from x where answer is not null and reason is not null) {_stats_sql()}""")
def q_runs_to_stats(spark, sf):
    """Files of all runs -> one scan -> extracted and scored rows -> statistics by model and perspective."""
    root = _fresh(spark, "runs")
    S.write_responses(json_responses(spark, sf), root)
    scored = lexicon_scored_responses(S.scan_all_runs(spark, root), small_lexicon(spark))
    return R.stats_by_model_perspective(scored)


@register("grid_cached", f"with {GRID_SQL} select {', '.join(GRID_COLS)} from grid")
def q_grid_cached(spark, sf):
    path = _fresh(spark, "grid")
    S.grid_cached(spark, path, lambda: _grid(spark, sf))            # builds and writes
    return S.grid_cached(spark, path, lambda: _grid(spark, sf)).select(*GRID_COLS)  # reads the cache


@register("lexicon_scan", f"""
select lower(token) as token, arg_max(category, ordinal) as category from {_part_lexicon_sql()} group by 1""")
def q_lexicon_scan(spark, sf):
    path = _fresh(spark, "lexicon-dic")
    write_dic_lexicon(_part_lexicon(spark, sf), path)
    return L.lexicon_map(read_dic_lexicon(spark, path))


MSCORE_SQL = ", ".join(f"(length(response) % {p}) / {float(p)} as {s}_mscore"
                       for s, p in zip(SCORE5, (97, 89, 83, 79, 73)))


def _v1_with_mscores(spark, sf):
    v1 = json_responses(spark, sf)
    return v1.withColumns({f"{s}_mscore": (F.length("response") % p) / float(p)
                           for s, p in zip(SCORE5, (97, 89, 83, 79, 73))})


@register("measurement_source", f"""with v1 as (select *, {MSCORE_SQL} from ({O.V1})), {O.EXTRACTED},
kept as (select * from x where answer is not null and reason is not null),
t as (select *, {' + '.join(f'coalesce({s}_mscore, 0)' for s in SCORE5)} as total_count from kept)
select row_key, answer, round(total_count, 9) as total_count,
  {', '.join(f'round({s}_mscore / nullif(total_count, 0), 9) as {s}_ratio' for s in SCORE5)} from t""")
def q_measurement_source(spark, sf):
    out = S.score(_v1_with_mscores(spark, sf), "mformer")
    return out.select("row_key", "answer", r9("total_count"), *[r9(m) for m in MORAL5])


@register("measurement_lexicon", _scored_v1_sql(
    "select row_key, answer, " + ", ".join([f"{f}_count" for f in O.FOUNDATIONS]
                                           + [f"round({f}_ratio, 9) as {f}_ratio" for f in O.FOUNDATIONS]) + " from scored"))
def q_measurement_lexicon(spark, sf):
    out = S.score(json_responses(spark, sf), "mfd", lexicon=small_lexicon(spark))
    return out.select("row_key", "answer", *[f"{f}_count" for f in O.FOUNDATIONS], *[r9(f"{f}_ratio") for f in O.FOUNDATIONS])


FOLDS = 5


def _bayes_sql(label: str) -> str:
    """Naive Bayes scores of the kept responses for one label, trained on the documents outside the response's fold."""
    return f"""
tok_{label} as (select d.doc_id % {FOLDS} as f, l.{label} as y, unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) as token
  from documents d join labels l using (doc_id) where l.{label} in (0, 1)),
cell_{label} as (select token, f, count(*) filter (where y = 1) as n1, count(*) filter (where y = 0) as n0 from tok_{label} group by all),
out_{label} as (select token, g.f, sum(n1) as n1, sum(n0) as n0 from cell_{label} c join (select unnest(range({FOLDS})) as f) g on c.f <> g.f group by all),
mass_{label} as (select f, sum(n1) as t1, sum(n0) as t0, count(*) as v from out_{label} group by f),
prior_{label} as (select g.f, ln((count(*) filter (where y = 1 and doc_id % {FOLDS} <> g.f) + 1) / (count(*) filter (where y = 0 and doc_id % {FOLDS} <> g.f) + 1)) as p
  from (select doc_id, l.{label} as y from documents d join labels l using (doc_id)) cross join (select unnest(range({FOLDS})) as f) g group by g.f),
s_{label} as (select row_key, sum(ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v))) as s
  from said join out_{label} o on o.token = said.token and o.f = said.f join mass_{label} m on m.f = said.f group by row_key)"""


BAYES_LABELS = ("quality", "toxic")


@register("classifier_scores", f"""with v1 as ({O.V1}), {O.EXTRACTED},
kept as (select row_key, reason, row_key % {FOLDS} as f from x where answer is not null and reason is not null),
said as (select row_key, f, unnest(regexp_extract_all(lower(reason), '[a-zA-Z]+')) as token from kept),
{', '.join(_bayes_sql(c) for c in BAYES_LABELS)}
select row_key, {', '.join(f"round(1 / (1 + exp(-greatest(least(prior_{c}.p + coalesce(s_{c}.s, 0), 700), -700))), 9) as {c}_mscore" for c in BAYES_LABELS)}
from kept {' '.join(f'join prior_{c} on prior_{c}.f = kept.f left join s_{c} using (row_key)' for c in BAYES_LABELS)}""")
def q_classifier_scores(spark, sf):
    """M1's native default: a response is scored by the model of the documents outside its own document's fold."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf, "labels", ["doc_id", *BAYES_LABELS])
    model = fit_bayes(docs.join(labels, "doc_id"), "text", BAYES_LABELS, F.col("doc_id") % FOLDS, FOLDS)
    kept = X.extract_and_clean(json_responses(spark, sf)).select("row_key", "reason")
    scored = bayes_scores(kept, model, text="reason", fold=F.col("row_key") % FOLDS)
    return scored.select("row_key", *[r9(f"{c}_mscore") for c in BAYES_LABELS])


LENGTH_SCORERS = dict(zip(SCORE5, (97, 89, 83, 79, 73)))


@register("classifier_injected", f"""with v1 as ({O.V1}), {O.EXTRACTED}
select row_key, {', '.join(f"(length(reason) % {p}) / {float(p)} as {s}_mscore" for s, p in LENGTH_SCORERS.items())}
from x where answer is not null and reason is not null""")
def q_classifier_injected(spark, sf):
    """M1 with injected scorers, one per foundation (a rule that SQL can restate)."""
    kept = X.extract_and_clean(json_responses(spark, sf)).select("row_key", "reason")
    scorers = {s: partial(length_scorer, p) for s, p in LENGTH_SCORERS.items()}
    return classifier_scores(kept, scorers).drop("reason")


ROUTE_SQL = ", ".join(f"('{k}', '{v}')" for k, v in ROUTES.items())


@register("respond_flow", f"""with v2 as ({O.V2}),
grid as (select * from (select distinct o_orderstatus as template from orders) cross join (select r_name as closeness from region)
         cross join (select distinct l_linenumber as severity from lineitem)),
j as (select *, '[' || template || '] ' || closeness || ' at level ' || severity as prompt from grid
      cross join (select distinct model from v2) cross join (select distinct perspective_run from v2)),
r as (select j.*, provider, 'prompt of ' || length(prompt) || ' characters' as reason from j left join (values {ROUTE_SQL}) t(model, provider) using (model))
select template, closeness, severity, model, perspective_run,
  case when provider is null then 'no provider serves the model ' || model
       else '{{"answer": "' || case when length(prompt) % 2 = 0 then 'Yes' else 'No' end || '", "reasoning": "' || reason || '"}}' end as response
from r""")
def q_respond_flow(spark, sf):
    """Grid -> jobs for every model and run -> routes -> responses; an unrouted model's error is its response."""
    t = read_table(spark, sf, "orders", ["o_orderstatus"]).distinct().withColumnRenamed("o_orderstatus", "template")
    c = read_table(spark, sf, "region").select(F.col("r_name").alias("closeness"))
    s = read_table(spark, sf, "lineitem", ["l_linenumber"]).distinct().withColumnRenamed("l_linenumber", "severity")
    grid = G.factor_grid([t, c, s])
    pairs = materialize(scored_rows(spark, sf).select("model", "perspective_run").distinct())
    jobs = G.job_grid(grid, pairs.select("model").distinct(), pairs.select("perspective_run").distinct())
    asked = G.route_models(jobs, ROUTES).withColumn("prompt", F.concat(
        F.lit("["), "template", F.lit("] "), "closeness", F.lit(" at level "), F.col("severity").cast("string")))
    out = map_responder(asked, stub_responder, reasoning=F.lit("low"), error_col="route_error")
    return out.select("template", "closeness", "severity", "model", "perspective_run", "response")


# ---------------------------------------------------------------- join-shaped operators

PERSPECTIVE_LABELS = {"F": "Finished", "O": "Open"}


@register("label_lookup", f"""with v2 as ({O.V2}),
p as (select distinct perspective from v2),
l as (select * from (values {', '.join(f"('{k}', '{v}')" for k, v in PERSPECTIVE_LABELS.items())}) t(key, label))
select p.perspective, coalesce(l.label, p.perspective) as perspective_label from p left join l on p.perspective = l.key""")
def q_label_lookup(spark, sf):
    p = scored_rows(spark, sf).select("perspective").distinct()
    return X.display_name(p, "perspective", PERSPECTIVE_LABELS, out="perspective_label")


@register("positional_attach", f"""with v1 as ({O.V1}), {O.EXTRACTED},
{O.lex_map_sql(False)}, {O.per_row_counts_sql('x', 'row_key', 'response', False)},
scored as (select x.row_key, x.answer, {O.score_select_sql('cnt.')} from x left join cnt using (row_key))
select row_key, answer, {', '.join(f'{f}_count' for f in O.FOUNDATIONS)} from scored""")
def q_positional_attach(spark, sf):
    """Answers and scores are attached to their own rows in one projection; no row is dropped."""
    x = X.extract_answer_reason(json_responses(spark, sf))
    s = L.lexicon_scores(x, small_lexicon(spark), col="response", stopwords=None)
    return s.select("row_key", "answer", *[f"{f}_count" for f in O.FOUNDATIONS])


from vigil.plans import catalog_more, catalog_runs  # noqa: E402,F401  register their queries
