"""Corpus pipeline: quality rules, near-duplicates, decontamination, personal data, source mixing.

Each stage takes the documents that its predecessor kept and works on all of
them; its decisions take effect in what it returns.  Every stage but the last
returns the columns of ``documents``; ``run`` writes each stage's result to the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import WORD, n_words, read, stored
from vigil.llm.decontam import decontaminate
from vigil.llm.fragjoin import ngram_jaccard
from vigil.llm.mixing import mix_sources
from vigil.llm.pii import personal_data, redact
from vigil.llm.quality import quality_rules
from vigil.operators.report import global_row_number
from vigil.plans.sizing import bounded_broadcast

#: No SQL: shingle components, alignment, bootstrapping and the knapsack have none; tests compare with plain versions.
ORACLE_SQL = None

#: Near-duplicates: words of a shingle, and the least percentage of the union that is shared.
SHINGLE_WORDS, PERCENT = 5, 80


def _with_length(docs: DataFrame, text: str) -> DataFrame:
    """``text`` as the documents' text, and ``n_chars`` as its length."""
    return docs.withColumns({"text": F.col(text), "n_chars": F.length(text).cast("long")})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    judged = quality_rules(docs).where("kept")
    return _with_length(judged, "clean_text").select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """The different rows with ``__number``: the id where it names one row only, else a number of its own after all ids.

    Of rows with one id the first (by the text's hash, then the text) keeps the id as its
    number.  Rows equal in id and text are one document and give one row.
    """
    seen = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1 or doc_id is null")
    seen = bounded_broadcast(stored(seen.select(F.col("doc_id").alias("__id")), "repeated-ids"))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once = docs.join(seen, same, "left_anti").withColumn("__number", F.col("doc_id").cast("long"))
    other = stored(docs.join(seen, same, "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("__h", F.xxhash64("text")), "repeated-documents")
    first = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("__h"))).orderBy("__h", "text")) == 1
    other = other.withColumn("__first", F.col("doc_id").isNotNull() & first)
    span = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("long").alias("low"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("long").alias("high")).first()
    late = global_row_number(other.where(~F.col("__first")), [F.asc_nulls_last("doc_id"), "__h", "text"], "__rank")
    # the numbers after the largest id, or before the smallest where there are none
    start = span["high"] if span["high"] < 1 << 62 else span["low"] - (1 << 61) if span["low"] > -(1 << 62) else 0
    late = late.withColumn("__number", F.col("__rank") + F.lit(start).cast("long"))
    kept = [*docs.columns, "__number"]
    return once.select(*kept).unionByName(other.where("__first").withColumn("__number", F.col("doc_id").cast("long")).select(*kept)) \
        .unionByName(late.select(*kept))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Rows without an id, and further texts of one id, are documents of their own and come
    after all ids; rows equal in id and text are one document.  Rows without words all stay.
    """
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = _numbered(docs.where(worded))
    found = ngram_jaccard(rows.select(F.col("__number").alias("doc_id"), "text"), n=SHINGLE_WORDS, percent=PERCENT)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = bounded_broadcast(stored(gone, "near-duplicates"))
    return rows.join(gone, F.col("__number") == F.col("__gone"), "left_anti").select(*docs.columns).unionByName(docs.where(~worded))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, items, out="__hits").where(F.size("__hits") == 0).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in the texts give way to their kind in brackets."""
    found = personal_data(docs)
    clean = found.withColumn("__clean", redact(F.col("text"), F.concat("base", "extra")))
    return _with_length(clean, "__clean").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: how often each document is read, with its source's size and target."""
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "sizes")
    return mix_sources(sized, tie=("doc_id", "text_hash")) \
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
