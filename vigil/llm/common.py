"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than the space and the control
characters 9 to 13 (``WORD``); this differs from Java's and Python's own idea
of white space, so every operator goes through the helpers below.

Row identity: ``doc_id`` may be null or repeated, so operators that look a
document up again key it by ``K1`` (``doc_id``, null as the largest long, i.e.
last) and ``K2`` (hash of the text).  Rows that agree in both are one document
to such an operator, and each of them gets that document's result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
K1, K2 = "__k1", "__k2"
NULL_ID = (1 << 63) - 1
#: Buckets of texts without an id that are numbered apart.
NULL_BUCKETS = 1_024


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, dealt to all cores if the scan has fewer splits than that."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def spread(df: DataFrame) -> DataFrame:
    """Deal an input of fewer splits than a third of the cores round-robin.

    The row-wise work that follows would otherwise run on a few tasks only.
    An input of many splits, as at scale, is left alone and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 3 <= cores else df


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_key(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """Non-null key columns of a document (see the module's text)."""
    return {K1: F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)),
            K2: F.xxhash64(F.col(text))}


def let(value: Column, use) -> Column:
    """``use(v)`` with ``v`` bound to ``value``, which is evaluated once per row.

    Catalyst substitutes a column's definition wherever it is used; a lambda
    variable keeps a costly array from being built again at every use.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def fresh(df: DataFrame, *names: str) -> str:
    """A column name that ``df`` does not have, from the first of ``names`` by adding underscores."""
    taken = {c.lower() for c in df.columns}
    name = names[0]
    while name.lower() in taken:
        name += "_"
    return name


#: Texts that travel to a Python worker together; bounds what a worker and its executor hold.
BATCH_ROWS = 2_000


def prepare_python(spark: SparkSession) -> None:
    """For operators with Python steps: ship the package, and keep Arrow batches of texts small.

    Lowers the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` to
    ``BATCH_ROWS`` if it is higher (Spark reads it when a plan runs).
    """
    from vigil.session import ship_package

    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(run):
    """A partition function that gives its memory back to the system when a task ends (workers are reused)."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def partitions_for(n: int, per_task: int, least: int = 1) -> int:
    """Number of shuffle partitions that leaves about ``per_task`` items in each."""
    return max(least, -(-int(n) // per_task))


def column_bytes(batch, i: int):
    """(data, starts, ends) of an Arrow string or binary column, nulls as empty values.

    ``data`` is the column's byte buffer as a numpy view; nothing is copied.
    """
    import numpy as np
    import pyarrow as pa

    col = batch.column(i)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = off[:-1].copy(), off[1:].copy()
    if col.null_count:
        null = np.asarray(col.is_null())
        ends[null] = starts[null]
    return buf, starts, ends


def byte_slices(batch, i: int, limit: int = 8 << 20) -> Iterator:
    """A record batch in slices of up to ``limit`` bytes of column ``i`` (one row at least; an empty batch as it is)."""
    import numpy as np

    _, starts, ends = column_bytes(batch, i)
    total = np.cumsum(ends - starts)
    at = 0
    while True:
        used = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, used + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
        if at >= batch.num_rows:
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back (cuts lineage, compressed, survives executors)."""
    import uuid

    from vigil.session import scratch_path

    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "__ord") -> DataFrame:
    """Adds K1 and an ordinal that tells apart the different texts of one ``doc_id`` (0 for an id's only text).

    Rows equal in id and text share both, so (K1, ordinal) names a document.  Texts of one
    id are ordered by hash.  Those without an id, which may be very many, are numbered
    within ``NULL_BUCKETS`` buckets of hashes, the numbers interleaved, so no task sorts
    all of them (up to 2^31 texts).
    """
    from pyspark.sql import Window

    from vigil.plans.sizing import bounded_broadcast

    keyed = docs.withColumns(doc_key(doc_id, text))
    named = F.col(K1) != NULL_ID
    many = keyed.groupBy(K1, K2).agg(F.count(F.lit(1)).alias("__n")) \
        .withColumn("__in", F.when(named, 0).otherwise(F.pmod(K2, F.lit(NULL_BUCKETS).cast("long")).cast("int")))
    place = F.row_number().over(Window.partitionBy(K1, "__in").orderBy(K2)) - 1
    many = many.withColumn("__o", place * F.when(named, 1).otherwise(NULL_BUCKETS) + F.col("__in")).where("__o > 0") \
        .select(F.col(K1).alias("__a"), F.col(K2).alias("__b"), "__o")
    many = bounded_broadcast(stored(many, "ordinals"))
    return keyed.join(many, (F.col(K1) == F.col("__a")) & (F.col(K2) == F.col("__b")), "left") \
        .withColumn(out, F.coalesce("__o", F.lit(0))).drop("__a", "__b", "__o", K2)
