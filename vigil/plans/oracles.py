"""DuckDB SQL for every checked query (an independent formulation).

Tables are the driver's views; the fixture views are inlined as CTEs.
"""

from __future__ import annotations

from vigil.functions.numeric import erfc_sql
from vigil.functions.stopwords import english_stopwords
from vigil.sources.fixtures import SMALL_LEXICON

V1 = r"""
select doc_id as row_key,
  concat('m', cast(doc_id % 6 as varchar)) as model,
  concat(case floor(doc_id / 6) % 3 when 0 then 'p' when 1 then 'd' else 'a' end,
         '_', cast(cast(1 + floor(doc_id / 7) % 3 as int) as varchar)) as perspective_run,
  cast(1 + floor(doc_id / 18) % 4 as int) as closeness_level,
  concat('c', cast(cast(1 + floor(doc_id / 18) % 4 as int) as varchar)) as closeness_level_name,
  cast(1 + floor(doc_id / 72) % 4 as int) as severity_level,
  case doc_id % 10
    when 0 then 'no object here'
    when 1 then concat('{''answer'': ''Yes'', ''reasoning'': ''', body, '''}')
    when 2 then concat('Sure. {"answer": "No", "reason": "', body, '"} done')
    when 3 then concat('{"answer": "Yes", "reason": "", "reasoning": "', body, '"}')
    when 4 then concat('{"answer": null, "reasoning": "', body, '"}')
    when 5 then concat('{"answer": "Yes", "reasoning": "a"} or {"answer": "No", "reasoning": "', body, '"}')
    else concat('{"answer": "', case when n_chars % 2 = 0 then 'Yes' else 'No' end,
                '", "reasoning": "', body, '"}') end as response
from (select *, regexp_replace(text, '[^a-zA-Z ]', ' ', 'g') as body from documents) z
"""

V2 = r"""
select concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
                 cast(l_partkey as varchar), cast(l_suppkey as varchar)) as row_key,
  concat('m', cast(l_suppkey % 6 as varchar)) as model,
  concat(o_orderstatus, '_', cast(1 + l_orderkey % 3 as varchar)) as perspective_run,
  o_orderstatus as perspective,
  cast(1 + l_linenumber % 4 as int) as closeness_level,
  concat('c', cast(1 + l_linenumber % 4 as varchar)) as closeness_level_name,
  cast(1 + l_partkey % 4 as int) as severity_level,
  case l_returnflag when 'R' then 'Yes' when 'A' then 'No' else 'Unsure' end as answer,
  case when l_quantity > 45 then 0.0e0 else l_quantity / 50e0 end as care_count,
  case when l_quantity > 45 then 0.0e0 else l_discount * 10e0 end as fairness_count,
  case when l_quantity > 45 then 0.0e0 else l_tax * 10e0 end as loyalty_count,
  case when l_quantity > 45 then 0.0e0 else l_extendedprice / 100000e0 end as authority_count,
  case when l_linenumber = 7 then 0.1e0 else 0.0e0 end as sanctity_count
from lineitem join orders on l_orderkey = o_orderkey
"""


def vlex() -> str:
    rows = ", ".join(f"('{t}', '{c}', {o})" for t, c, o in SMALL_LEXICON)
    return f"(select * from (values {rows}) as l(token, category, ordinal))"


def stopword_list_sql() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in english_stopwords())


# Extraction in SQL: regexp span + json validity + field access.
EXTRACTED = r"""
c as (select *, regexp_extract(regexp_replace(replace(response, '\''', ''''), '[\x00-\x1F]', ' ', 'g'),
                               '(?s)\{.*\}') as obj from v1),
x as (select *,
        case when json_valid(obj) then json_extract_string(obj, '$.answer') end as answer,
        case when json_valid(obj) then coalesce(nullif(json_extract_string(obj, '$.reason'), ''),
                                                json_extract_string(obj, '$.reasoning')) end as reason
      from c)
"""

CATS = ["authority.vice", "authority.virtue", "care.vice", "care.virtue", "fairness.vice",
        "fairness.virtue", "loyalty.vice", "loyalty.virtue", "sanctity.vice", "sanctity.virtue"]
FOUNDATIONS = ["authority", "care", "fairness", "loyalty", "sanctity"]


def lex_map_sql(stop: bool) -> str:
    where = f"where lower(token) not in ({stopword_list_sql()})" if stop else ""
    return (f"lexm as (select lower(token) as token, arg_max(category, ordinal) as category "
            f"from {vlex()} group by 1), lexs as (select * from lexm {where})")


def per_row_counts_sql(src: str, key: str, col: str, stop_rowside: bool) -> str:
    """Counts per row key via unnest + join; stopwords (if any) removed on the row side."""
    stop = f"where token not in ({stopword_list_sql()})" if stop_rowside else ""
    counts = ", ".join(f"count(*) filter (where category = '{c}') as \"{c.replace('.', '_')}_count\""
                       for c in CATS)
    return f"""
toks as (select {key}, unnest(regexp_extract_all(lower(coalesce({col}, 'nan')), '[a-zA-Z]+')) as token from {src}),
toks2 as (select * from toks {stop}),
hits as (select {key}, category from toks2 join lexs using (token)),
cnt as (select {key}, count(*) as matched, {counts} from hits group by {key})
"""


def score_select_sql(prefix: str = "") -> str:
    parts = []
    for c in CATS:
        n = c.replace(".", "_")
        parts.append(f"cast(coalesce({prefix}{n}_count, 0) as bigint) as {n}_count")
        parts.append(f"coalesce({prefix}{n}_count, 0) / greatest(coalesce({prefix}matched, 0), 1) as {n}_ratio")
    for f in FOUNDATIONS:
        s = " + ".join(f"coalesce({prefix}{c.replace('.', '_')}_count, 0)" for c in CATS if c.startswith(f + "."))
        parts.append(f"cast({s} as bigint) as {f}_count")
        parts.append(f"({s}) / greatest(coalesce({prefix}matched, 0), 1) as {f}_ratio")
    return ",\n  ".join(parts)


def r9(expr: str, alias: str) -> str:
    return f"round({expr}, 9) as {alias}"


def ols_hc3_sql(src: str, keys: list[str], ys: list[str], x1: str, x2: str, z975: float) -> str:
    """HC3 slopes from the uncentred 3x3 normal equations (cofactor inverse).

    CTEs ending in ``ols`` with columns keys, moral, term, coef, se, ci_low,
    ci_high, p, n.  ``src`` must be a CTE name holding keys, x1, x2 and ys.
    """
    ks = ", ".join(keys)
    long = " union all ".join(
        f"select {ks}, '{y}' as moral, cast({x1} as double) as u, cast({x2} as double) as v, {y} as y "
        f"from {src} where {y} is not null and {x1} is not null and {x2} is not null" for y in ys)
    gk = f"{ks}, moral"
    on = " and ".join(f"lg.{k} = g.{k}" for k in [*keys, "moral"])
    sel = ", ".join(f"g.{k}" for k in [*keys, "moral"])
    terms = []
    for term, coef, var in ((x1, "b1", "v1"), (x2, "b2", "v2")):
        terms.append(f"""select {gk}, '{term}' as term, {coef} as coef,
  case when {coef} is not null and hmax < 1 - 1e-12 then sqrt({var}) end as se, n from meat""")
    return f"""
lg as ({long}),
m as (select {gk}, count(*) as n, sum(u) as su, sum(v) as sv, sum(u * u) as suu, sum(v * v) as svv,
             sum(u * v) as suv, sum(y) as sy, sum(u * y) as suy, sum(v * y) as svy from lg group by {gk}),
cof as (select *, suu * svv - suv * suv as c00, sv * suv - su * svv as c01, su * suv - suu * sv as c02,
               n * svv - sv * sv as c11, su * sv - n * suv as c12, n * suu - su * su as c22 from m),
inv as (select *, n * c00 + su * c01 + sv * c02 as det from cof),
g as (select *, case when c22 > 0 and c11 > 0 and (n * c00 + su * c01 + sv * c02) / n > 1e-12 * (c22 / n) * (c11 / n)
                     then 1 end as ok from inv),
beta as (select *, case when ok = 1 then (c00 * sy + c01 * suy + c02 * svy) / det end as b0,
                   case when ok = 1 then (c01 * sy + c11 * suy + c12 * svy) / det end as b1,
                   case when ok = 1 then (c02 * sy + c12 * suy + c22 * svy) / det end as b2 from g),
rw as (select {sel}, g.n, g.b1, g.b2,
              lg.y - g.b0 - g.b1 * lg.u - g.b2 * lg.v as e,
              (g.c00 + 2 * g.c01 * lg.u + 2 * g.c02 * lg.v + g.c11 * lg.u * lg.u + 2 * g.c12 * lg.u * lg.v
               + g.c22 * lg.v * lg.v) / g.det as h,
              (g.c01 + g.c11 * lg.u + g.c12 * lg.v) / g.det as g1,
              (g.c02 + g.c12 * lg.u + g.c22 * lg.v) / g.det as g2
       from lg join beta g on {on}),
meat as (select {gk}, n, b1, b2, max(h) as hmax,
                sum(g1 * g1 * (e / (1 - h)) * (e / (1 - h))) as v1,
                sum(g2 * g2 * (e / (1 - h)) * (e / (1 - h))) as v2 from rw group by {gk}, n, b1, b2),
tm as ({' union all '.join(terms)}),
tz as (select *, abs(coef / nullif(se, 0)) / sqrt(2.0e0) as zx from tm),
ols as (select {gk}, term, coef, se, coef - {z975!r} * se as ci_low, coef + {z975!r} * se as ci_high,
               {erfc_sql('zx')} as p, cast(n as bigint) as n from tz)"""
