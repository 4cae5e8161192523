"""Response files: scans, multi-run scans, partitioned sinks, cached grids,
and the measurement switch (S1-S4, S6).

Inside the pipeline responses live in Parquet partitioned by
``perspective_run`` and ``model`` (partition pruning replaces the reference's
one-file-per-run layout).  CSV is supported for exchange: pandas writes
embedded quotes doubled, hence ``escape='"'``; multi-line CSV is not
splittable, so large inputs should be converted to Parquet once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigil.functions.text import strip_run_suffix

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def scan_responses(spark: SparkSession, path: str, schema: StructType | str | None = None,
                   fmt: str = "csv") -> DataFrame:
    """Read one responses table (CSV with quoted multi-line text, or Parquet).
    Without a schema, CSV columns are read as strings (no inference pass)."""
    if fmt == "parquet":
        r = spark.read
        return (r.schema(schema) if schema else r).parquet(path)
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}")
    r = spark.read.options(**CSV_OPTIONS)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def _reader(spark: SparkSession, fmt: str, schema):
    reader = spark.read.options(**CSV_OPTIONS) if fmt == "csv" else spark.read
    return reader if schema is None else reader.schema(schema)


def scan_all_runs(spark: SparkSession, root: str, fmt: str = "parquet", layout: str = "hive",
                  schema: StructType | str | None = None, combine_runs: bool = False,
                  run_col: str = "perspective_run", model_col: str = "model") -> DataFrame:
    """Every (run, model) table under ``root`` in one scan, tagged.

    ``hive``: ``root/perspective_run=<run>/model=<model>/`` (partition columns;
    filters on run or model prune folders; both are strings, also when a value
    looks like a number).  ``files``: ``root/<run>/<model>.<ext>``; run and model
    come from the file path.
    """
    root = root.rstrip("/")
    if layout == "hive":
        # a partition column keeps its text only if the read schema names it
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if kind is None:
            kind = _reader(spark, fmt, None).option("basePath", root).format(fmt).load(root).schema
        kind = StructType([f for f in kind.fields if f.name not in (run_col, model_col)]
                          + [StructField(c, StringType(), True) for c in (run_col, model_col)])
        df = _reader(spark, fmt, kind).option("basePath", root).format(fmt).load(root)
    elif layout == "files":
        df = _reader(spark, fmt, schema).format(fmt).load(f"{root}/*/*.{fmt}")
        path = F.col("_metadata.file_path")
        df = df.withColumns({
            run_col: F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1),
            model_col: F.regexp_extract(path, r"/([^/]+)\.[^./]+$", 1),
        })
    else:
        raise ValueError(f"unknown layout {layout!r}")
    persp = strip_run_suffix(F.col(run_col)) if combine_runs else F.col(run_col)
    return df.withColumn("perspective", persp)


def write_responses(df: DataFrame, root: str, fmt: str = "parquet",
                    partition_cols: Sequence[str] = ("perspective_run", "model"),
                    mode: str = "overwrite", max_records_per_file: int = 5_000_000,
                    balance: bool = False) -> None:
    """S3: partitioned write; overwrite replaces only the partitions present in ``df``.

    Default: no shuffle; each task writes its own rows per partition value (a
    hot run/model is spread over all tasks, not one), at the price of up to
    tasks x values files.  ``balance`` adds one shuffle (``REBALANCE`` by the
    partition columns): AQE coalesces small outputs and splits a skewed value
    over several tasks, so files come out near the advisory partition size.
    """
    cols = list(partition_cols)
    if balance and cols:
        df = df.hint("rebalance", *cols)
    w = (df.sortWithinPartitions(*cols).write.mode(mode).partitionBy(*cols)
         .option("partitionOverwriteMode", "dynamic")
         .option("maxRecordsPerFile", max_records_per_file))
    if fmt == "csv":
        w = w.options(**{k: v for k, v in CSV_OPTIONS.items() if k != "mode"})
    w.format(fmt).save(root)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def grid_cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], fmt: str = "parquet") -> DataFrame:
    """Read the table at ``path`` if it was written to its end, else build,
    write and read it back.  A folder without the writer's ``_SUCCESS`` mark is
    an unfinished write and is replaced."""
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


MEASUREMENTS = ("mfd", "mformer")


def score(df: DataFrame, measurement: str, lexicon: DataFrame | None = None, col: str = "response",
          **kw) -> DataFrame:
    """Choose the scoring branch by name; an unknown name is an error.

    ``mfd``: extract answers, then lexicon scores of ``col``.
    ``mformer``: extract answers, then ratios from ``*_mscore`` columns.
    """
    from vigil.operators.classify import ratios_from_scores
    from vigil.operators.extract import extract_and_clean
    from vigil.operators.lexicon import lexicon_scores

    if measurement not in MEASUREMENTS:
        raise ValueError(f"no such measurement: {measurement!r}; one of {MEASUREMENTS}")
    kept = extract_and_clean(df, "response")
    if measurement == "mfd":
        if lexicon is None:
            raise ValueError("measurement 'mfd' needs a lexicon")
        return lexicon_scores(kept, lexicon, col=col, **kw)
    return ratios_from_scores(kept)
