"""Registered queries of further analyses: densities from moments, entries of several words, agreement of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import lexicon as L
from vigil.operators.agreement import coincidences, run_agreement
from vigil.operators.density import grouped_kde_moments
from vigil.plans import oracles as O
from vigil.plans.catalog import CATS, r9, register
from vigil.sources.fixtures import SMALL_LEXICON, scored_rows
from vigil.sources.tables import read_table

# ---------------------------------------------------------------- A6 on rows


@register("grouped_kde_rows", f"""with v2 as ({O.V2}),
st as (select model, perspective, count(authority_count) as n, stddev_samp(authority_count) as sd,
              min(authority_count) as vmin, max(authority_count) as vmax from v2 group by all),
st2 as (select *, sd * pow(cast(n as double), -0.2) as bw from st where n >= 2 and sd > 0),
st3 as (select *, vmin - 2.0 * bw as lo, ((vmax + 2.0 * bw) - (vmin - 2.0 * bw)) / 199.0 as step from st2),
vals as (select model, perspective, authority_count as v, count(*) as c from v2 group by all),
g as (select st3.*, v, c, cast(point as int) as point from vals join st3 using (model, perspective) cross join generate_series(0, 199) t(point))
select model, perspective, point, round(lo + point * step, 9) as x,
       round(sum(c * exp(-0.5 * ((lo + point * step - v) / bw) * ((lo + point * step - v) / bw))) * (1.0 / sqrt(2.0 * pi())) / (n * bw), 9) as density
from g group by model, perspective, point, lo, step, n, bw""")
def q_grouped_kde_rows(spark, sf):
    """Density of a row-level score with many different values, from the moments of boxes."""
    k = grouped_kde_moments(scored_rows(spark, sf), col="authority_count")
    return k.select("model", "perspective", "point", r9("x"), r9("density"))


# ---------------------------------------------------------------- L2/L4, entries of several words


def _phrase_words() -> dict[str, str]:
    """Token text -> category of the small lexicon and some longer entries; the last entry of a token wins."""
    return {t.lower(): c for t, c, _ in PHRASES}


#: The small lexicon (one of its entries has two words) and entries of two and three of the corpus' words.
PHRASES = [*SMALL_LEXICON, ("of the of", "loyalty.vice", 13), ("in the", "fairness.virtue", 14), ("Terms of Service", "authority.virtue", 15),
           ("privacy policy", "care.virtue", 16), ("click", "sanctity.vice", 17), ("click here", "sanctity.virtue", 18), ("don't", "loyalty.virtue", 19)]


def _phrase_sql() -> str:
    entries = {t.replace("'", " "): c for t, c in _phrase_words().items()}
    longest_first = "|".join(sorted(entries, key=lambda t: (-t.count(" "), t)))
    hit = ", ".join(f"len(list_filter(m, lambda t: t in ({', '.join(repr(t) for t, k in entries.items() if k == c) or repr('')})))::bigint "
                    f"as {c.replace('.', '_')}_count" for c in CATS)
    return f"""select doc_id, {hit}, len(m)::bigint as matched_count
from (select doc_id, regexp_extract_all(array_to_string(regexp_extract_all(lower(coalesce(text, 'nan')), '[a-zA-Z]+'), ' '), '\\b({longest_first})\\b') as m
  from documents)"""


@register("lexicon_phrases", _phrase_sql())
def q_lexicon_phrases(spark, sf):
    """Entries of several words match, leftmost and longest."""
    lex = spark.createDataFrame(PHRASES, "token string, category string, ordinal long")
    s = L.lexicon_scores(read_table(spark, sf, "documents", ["doc_id", "text"]), lex, col="text", categories=CATS, stopwords=None,
                         keep_matched=True, phrases=True)
    return s.select("doc_id", *[f"{c.replace('.', '_')}_count" for c in CATS], "matched_count")


# ---------------------------------------------------------------- agreement of runs

UNITS = """units as (select model, perspective, closeness_level, severity_level, answer, count(*) as c,
    sum(count(*)) over (partition by model, perspective, closeness_level, severity_level) as m
  from v2 group by model, perspective, closeness_level, severity_level, answer)"""


@register("run_agreement", f"""with v2 as ({O.V2}), {UNITS},
u as (select * from units where m >= 2),
cell as (select model, perspective, closeness_level, severity_level, any_value(m) as m, count(*) as kinds, sum(c * (m - c)) / (any_value(m) - 1) as d from u group by all),
seen as (select model, perspective, count(*) as n_units, sum(m) as n_answers, count(*) filter (where kinds = 1) as n_same, sum(d) as observed from cell group by all),
t as (select model, perspective, answer, sum(c) as t from u group by all),
e as (select a.model, a.perspective, sum(a.t * b.t) as pairs from t a join t b on a.model = b.model and a.perspective = b.perspective and a.answer <> b.answer group by all)
select model, perspective, n_units, n_answers::bigint as n_answers, n_same, round(observed, 6) as observed,
  round(pairs / (n_answers - 1), 6) as expected, round(1 - observed / (pairs / (n_answers - 1)), 9) as alpha
from seen join e using (model, perspective)""")
def q_run_agreement(spark, sf):
    """Krippendorff's alpha of the runs' answers per model and perspective."""
    a = run_agreement(scored_rows(spark, sf))
    return a.select("model", "perspective", "n_units", "n_answers", "n_same", F.round("observed", 6).alias("observed"),
                    F.round("expected", 6).alias("expected"), r9("alpha"))


@register("run_coincidences", f"""with v2 as ({O.V2}), {UNITS}
select a.model, a.perspective, a.answer as first, b.answer as second,
  round(sum(case when a.answer = b.answer then a.c * (a.c - 1) else a.c * b.c end / (a.m - 1)), 6) as count
from units a join units b using (model, perspective, closeness_level, severity_level) where a.m >= 2 group by 1, 2, 3, 4""")
def q_run_coincidences(spark, sf):
    """How often two answers meet in a cell, per model and perspective."""
    c = coincidences(scored_rows(spark, sf), ["Yes", "No", "Unsure"])
    return c.select("model", "perspective", "first", "second", F.round("count", 6).alias("count"))
