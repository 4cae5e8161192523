"""Views over the driver tables that have the shape of the study's tables.

* ``json_responses``: one messy JSON response per document (answer/reasoning
  object, sometimes wrapped in prose, quoted wrongly or duplicated).
* ``scored_rows``: one scored response per line item (keys, answer and five
  foundation scores), joined to its order for the perspective.
* ``small_lexicon``: a twelve-entry category lexicon for tests and checks.

Both views grow with the tables they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.tables import read_table


def _s(c: Column) -> Column:
    return c.cast("string")


# Fixed value: every ASCII character that is neither a letter nor a space.
_ASCII_NON_LETTERS = "".join(chr(i) for i in range(128) if not (chr(i).isascii() and chr(i).isalpha()) and i != 32)


def letters_and_spaces(text: Column) -> Column:
    """Each character outside ``[a-zA-Z ]`` becomes a space.

    Same result as ``regexp_replace(text, '[^a-zA-Z ]', ' ')``, in two cheap
    passes: one regex pass for non-ASCII code points, then a per-character
    ``translate`` for the ASCII ones.
    """
    t = F.regexp_replace(text, "[^\\x00-\\x7F]", " ")
    return F.translate(t, _ASCII_NON_LETTERS, " " * len(_ASCII_NON_LETTERS))


def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    doc = F.col("doc_id")
    body = letters_and_spaces(F.col("text"))
    k = doc % 10
    yes_no = F.when(F.col("n_chars") % 2 == 0, F.lit("Yes")).otherwise(F.lit("No"))
    response = (
        F.when(k == 0, F.lit("no object here"))
        .when(k == 1, F.concat(F.lit("{'answer': 'Yes', 'reasoning': '"), body, F.lit("'}")))
        .when(k == 2, F.concat(F.lit('Sure. {"answer": "No", "reason": "'), body, F.lit('"} done')))
        .when(k == 3, F.concat(F.lit('{"answer": "Yes", "reason": "", "reasoning": "'), body, F.lit('"}')))
        .when(k == 4, F.concat(F.lit('{"answer": null, "reasoning": "'), body, F.lit('"}')))
        .when(k == 5, F.concat(F.lit('{"answer": "Yes", "reasoning": "a"} or {"answer": "No", "reasoning": "'),
                               body, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"answer": "'), yes_no, F.lit('", "reasoning": "'), body, F.lit('"}')))
    )
    persp = F.when(F.floor(doc / 6) % 3 == 0, F.lit("p")).when(F.floor(doc / 6) % 3 == 1, F.lit("d")) \
        .otherwise(F.lit("a"))
    closeness = (F.lit(1) + F.floor(doc / 18) % 4).cast("int")
    return d.select(
        doc.alias("row_key"),
        F.concat(F.lit("m"), _s(doc % 6)).alias("model"),
        F.concat(persp, F.lit("_"), _s((F.lit(1) + F.floor(doc / 7) % 3).cast("int"))).alias("perspective_run"),
        closeness.alias("closeness_level"),
        F.concat(F.lit("c"), _s(closeness)).alias("closeness_level_name"),
        (F.lit(1) + F.floor(doc / 72) % 4).cast("int").alias("severity_level"),
        response.alias("response"),
    )


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_discount", "l_tax", "l_extendedprice", "l_returnflag"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"], spread=False)
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    big = F.col("l_quantity") > 45

    def score(expr: Column) -> Column:
        return F.when(big, F.lit(0.0)).otherwise(expr)

    return j.select(
        F.concat_ws("-", _s(F.col("l_orderkey")), _s(F.col("l_linenumber")),
                    _s(F.col("l_partkey")), _s(F.col("l_suppkey"))).alias("row_key"),
        F.concat(F.lit("m"), _s(F.col("l_suppkey") % 6)).alias("model"),
        F.concat(F.col("o_orderstatus"), F.lit("_"), _s(F.lit(1) + F.col("l_orderkey") % 3)).alias("perspective_run"),
        F.col("o_orderstatus").alias("perspective"),
        (F.lit(1) + F.col("l_linenumber") % 4).cast("int").alias("closeness_level"),
        F.concat(F.lit("c"), _s(F.lit(1) + F.col("l_linenumber") % 4)).alias("closeness_level_name"),
        (F.lit(1) + F.col("l_partkey") % 4).cast("int").alias("severity_level"),
        F.when(F.col("l_returnflag") == "R", F.lit("Yes")).when(F.col("l_returnflag") == "A", F.lit("No"))
        .otherwise(F.lit("Unsure")).alias("answer"),
        score(F.col("l_quantity") / 50.0).alias("care_count"),
        score(F.col("l_discount") * 10.0).alias("fairness_count"),
        score(F.col("l_tax") * 10.0).alias("loyalty_count"),
        score(F.col("l_extendedprice") / 100000.0).alias("authority_count"),
        F.when(F.col("l_linenumber") == 7, F.lit(0.1)).otherwise(F.lit(0.0)).alias("sanctity_count"),
    )


# The twelve-entry test lexicon (token, category, file order).
SMALL_LEXICON = [
    ("the", "care.virtue", 1), ("on", "care.vice", 2), ("of", "fairness.virtue", 3),
    ("in", "fairness.vice", 4), ("and", "loyalty.virtue", 5), ("that", "loyalty.vice", 6),
    ("with", "authority.virtue", 7), ("er", "authority.vice", 8), ("to", "sanctity.virtue", 9),
    ("st", "sanctity.vice", 10), ("The", "authority.vice", 11), ("of the", "care.vice", 12),
]


def small_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SMALL_LEXICON, "token string, category string, ordinal long")
