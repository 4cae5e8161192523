"""Streaming versions of the row-wise stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vigil.functions.numeric import is_yes
from vigil.operators.extract import extract_and_clean
from vigil.operators.lexicon import DEFAULT_STOPWORDS, lexicon_scores
from vigil.plans.study import with_perspective


def scored_stream(spark: SparkSession, source: str, schema: StructType | str, lexicon: DataFrame,
                  categories: Sequence[str] | None = None, fmt: str = "parquet",
                  max_files_per_trigger: int = 64, col: str = "response",
                  stopwords=DEFAULT_STOPWORDS) -> DataFrame:
    """Response files arriving under ``source`` -> extracted, lexicon-scored rows.

    The lexicon is a static, size-checked table turned into literal sets, so
    the streaming plan has no join and no state.
    """
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .format(fmt).load(source))
    kept = extract_and_clean(src, "response")
    scored = lexicon_scores(kept, lexicon, col=col, categories=categories, stopwords=stopwords,
                            strategy="inset")
    return with_perspective(scored)


def start_scored_sink(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      available_now: bool = True, partition_cols: Sequence[str] = ()) -> StreamingQuery:
    """Append scored rows to files; exactly-once through the checkpoint."""
    w = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink)


def streaming_yes_counts(stream: DataFrame, keys: Sequence[str] = ("model", "perspective"),
                         answer: str = "answer", positive: str = "Yes") -> DataFrame:
    """Running counts behind A2 (rows, positives) per key; ratios are
    ``yes / rows`` on the output.  Use ``update`` or ``complete`` mode."""
    y = is_yes(answer, positive)
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(y).cast("long").alias("yes"))
