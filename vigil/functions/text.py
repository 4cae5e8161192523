"""Text expressions: tokenising, run-suffix stripping, model names, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tokens are maximal runs of ASCII letters after lower-casing.
TOKEN_PATTERN = "[a-zA-Z]+"
# Fixed value: the run suffixes that name re-runs of one perspective.
RUN_SUFFIX_PATTERN = "_[123]\\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text, null_as: str | None = "nan") -> Column:
    """Lower-case then extract maximal ASCII-letter runs (array<string>).

    A NULL text is scored as the literal ``null_as`` (the reference turns a
    missing value into the text ``nan`` before tokenising).
    """
    t = _c(text)
    if null_as is not None:
        t = F.coalesce(t.cast("string"), F.lit(null_as))
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)


def token_counts(tokens: Column) -> Column:
    """The different tokens of an array with their numbers: array<struct<token, n>>, sorted by token.

    A row's repeated tokens collapse before anything is exploded.  The sorted array is
    bound to a lambda variable, so it is built once per row.
    """
    def counted(s):
        new = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        runs = F.transform(F.array(new), lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n"))))
        return F.get(runs, F.lit(0))

    empty = F.array().cast("array<struct<token:string,n:bigint>>")
    return F.get(F.transform(F.array(F.array_sort(tokens)), lambda s: F.when(F.size(s) > 0, counted(s)).otherwise(empty)), F.lit(0))


def longest_entries(tokens: Column, entries) -> Column:
    """Entries of one or several words in a token array, leftmost first and longest first, none overlapping.

    ``entries`` are texts of tokens with one space between.  A place is tried only if its
    token begins an entry; the longest entry there wins and the scan goes on behind it.
    """
    by_size: dict[int, list[str]] = {}
    for e in entries:
        by_size.setdefault(e.count(" ") + 1, []).append(e)
    if not by_size:
        return F.array().cast("array<string>")
    firsts = sorted({e.split(" ", 1)[0] for e in entries})

    def scanned(s):
        text = lambda i, size: F.array_join(F.slice(s, i + 1, F.lit(size)), " ")

        def at(t, i):
            found = None
            for size in sorted(by_size, reverse=True):
                hit = (i + size <= F.size(s)) & (t if size == 1 else text(i, size)).isin(by_size[size])
                found = F.when(hit, F.lit(size)) if found is None else found.when(hit, F.lit(size))
            return F.when(t.isin(firsts), found.otherwise(F.lit(0))).otherwise(F.lit(0))

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,size:int>>").alias("hits"))
        places = F.filter(F.transform(s, lambda t, i: F.struct(i.alias("i"), at(t, i).alias("size"))), lambda p: p["size"] > 0)
        take = lambda acc, p: F.when(p["i"] < acc["next"], acc).otherwise(
            F.struct((p["i"] + p["size"]).alias("next"), F.array_append(acc["hits"], p).alias("hits")))
        return F.transform(F.aggregate(places, start, take, lambda acc: acc["hits"]), lambda p: F.array_join(F.slice(s, p["i"] + 1, p["size"]), " "))

    return F.get(F.transform(F.array(tokens), scanned), F.lit(0))


def strip_run_suffix(col) -> Column:
    """``x_1``/``x_2``/``x_3`` -> ``x``; anything else unchanged (strips once)."""
    return F.regexp_replace(_c(col), RUN_SUFFIX_PATTERN, "")


def short_model_name(model, reasoning=None) -> Column:
    """Last ``/`` segment of a model id, plus ``_<reasoning>`` when set."""
    base = F.element_at(F.split(_c(model), "/"), -1)
    if reasoning is None:
        return base
    r = _c(reasoning)
    return F.when(F.coalesce(r, F.lit("")) == "", base).otherwise(F.concat_ws("_", base, r))


def sanitize_name(name: str) -> str:
    """Category names such as ``care.virtue`` become ``care_virtue``."""
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


_PIECES = r"\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}]"


def render_template(template, mapping: dict) -> Column:
    """Single-pass ``str.format``-style substitution.

    The template is cut into pieces (literal runs, ``{{``, ``}}``,
    ``{name}`` fields); each piece is replaced once, so an inserted value that
    itself contains ``{name}`` is never expanded again.  An unknown field or a
    lone brace raises, like ``str.format``.
    """
    t = _c(template)
    values = {k: _c(v).cast("string") for k, v in mapping.items()}

    def piece(p):
        expr = F.when(p == "{{", F.lit("{")).when(p == "}}", F.lit("}"))
        for name, v in values.items():
            expr = expr.when(p == "{" + name + "}", v)
        bad = p.startswith("{") | p.startswith("}")
        return expr.when(bad, F.raise_error(F.concat(F.lit("bad template field: "), p))
                         .cast("string")).otherwise(p)

    pieces = F.regexp_extract_all(t, F.lit(_PIECES), 0)
    return F.when(t.isNull(), F.lit(None).cast("string")).otherwise(
        F.array_join(F.transform(pieces, piece), ""))
