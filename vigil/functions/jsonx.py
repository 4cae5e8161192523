"""Strict extraction of a JSON object embedded in free text.

Semantics (the reference's extraction of ``answer`` and ``reason``):

1. ``\\'`` becomes ``'``; every character below U+0020 becomes a space.
2. The candidate is the greedy span from the first ``{`` to the last ``}``.
3. It must be one strict JSON value: no single quotes, no comments, no
   trailing data.  Anything else yields (NULL, NULL).
4. ``answer`` is the ``answer`` field; ``reason`` is ``reason`` when truthy
   (Python truthiness), else ``reasoning``.  Non-string values come back as
   their JSON text; a NaN value counts as missing.

Spark's ``from_json`` silently ignores trailing data, so the candidate is
parsed twice: wrapped in ``[...]`` (must give exactly one element) and as the
value of a one-field object (must parse).  Together they reject
``{..} x {..}``, ``{..},{..}``, ``{..}]}`` and ``{..}}``.  Fields are read as
VARIANT so that the JSON type survives for the truthiness test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_OPTIONS = {
    "mode": "PERMISSIVE",
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
    "allowNumericLeadingZeros": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "allowUnquotedControlChars": "false",
    "allowNonNumericNumbers": "true",
}

_FIELDS = "answer variant, reason variant, reasoning variant"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def candidate_object(text) -> Column:
    """Steps 1-2: cleaned text, greedy ``{...}`` span or NULL."""
    t = F.replace(_c(text), F.lit("\\'"), F.lit("'"))
    t = F.regexp_replace(t, "[\\x00-\\x1F]", " ")
    return F.regexp_substr(t, F.lit("(?s)\\{.*\\}"))


def _strict_from_candidate(obj: Column, fields: str = _FIELDS) -> Column:
    as_array = F.from_json(F.concat(F.lit("["), obj, F.lit("]")),
                           f"array<struct<{fields.replace(' variant', ':variant')}>>",
                           STRICT_OPTIONS)
    wrapped = F.from_json(F.concat(F.lit('{"v":'), obj, F.lit("}")), "v string", STRICT_OPTIONS)
    ok = (F.size(as_array) == 1) & wrapped["v"].isNotNull()
    return F.when(ok, F.element_at(as_array, 1))


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def variant_text(v: Column) -> Column:
    """String values as text, other JSON values as their JSON text, null -> NULL."""
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("string"))
            .when(_vtype(v) == "STRING", F.variant_get(v, "$", "string"))
            # to_json puts an infinite number in quotes
            .when(_vtype(v) == "DOUBLE", F.replace(F.to_json(v), F.lit('"')))
            .otherwise(F.to_json(v)))


def _is_nan(v: Column) -> Column:
    return F.coalesce((_vtype(v).isin("DOUBLE", "FLOAT"))
                      & F.isnan(F.try_variant_get(v, "$", "double")), F.lit(False))


def variant_truthy(v: Column) -> Column:
    """Python truthiness of a JSON value held as VARIANT."""
    txt = variant_text(v)
    typ = _vtype(v)
    return (F.when(txt.isNull(), F.lit(False))
            .when(typ == "STRING", txt != "")
            .when(typ == "BOOLEAN", txt == "true")
            .when(txt.isin("[]", "{}"), F.lit(False))
            .when(typ.startswith("ARRAY") | typ.startswith("OBJECT"), F.lit(True))
            .otherwise(F.coalesce(txt.try_cast("double") != 0, F.lit(True))))


def _not_nan_text(v: Column) -> Column:
    return F.when(_is_nan(v), F.lit(None).cast("string")).otherwise(variant_text(v))


def answer_reason_from_record(rec: Column) -> Column:
    a, r, rr = rec["answer"], rec["reason"], rec["reasoning"]
    reason_v = F.when(variant_truthy(r), r).otherwise(rr)
    return F.struct(_not_nan_text(a).alias("answer"), _not_nan_text(reason_v).alias("reason"))


def with_answer_reason(df, text_col: str, answer: str = "answer", reason: str = "reason"):
    """Add ``answer``/``reason`` in stages: span, strict parse, then field logic.

    Each stage is its own projection; Catalyst does not collapse a projection
    whose expensive expression (``from_json``) is referenced several times,
    so the text is scanned and parsed once per row.
    """
    # of a repeated key the last counts, as in Python's json
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    obj, rec = "__vigil_obj", "__vigil_rec"
    staged = df.withColumn(obj, candidate_object(F.col(text_col)))
    staged = staged.withColumn(rec, _strict_from_candidate(F.col(obj))).drop(obj)
    out = answer_reason_from_record(F.col(rec))
    # The two fields are produced by a one-element generator: a later filter
    # on them (drop incomplete rows) then stays above it instead of being
    # pushed down and re-evaluating the parse inside the filter.
    keep = [F.col(c) for c in staged.columns if c not in (rec, answer, reason)]
    pair = F.struct(out["answer"].alias(answer), out["reason"].alias(reason))
    return staged.select(*keep, F.inline(F.array(pair)))
