"""S4 by content: a saved grid is used only while its factor tables are what they were.

The cache's name is an order-independent fingerprint of the factor tables (columns,
types and rows, repeats included).  A builder writes to a folder of its own beside it and
publishes that by a rename that fails if the name is taken, so two builders never
overwrite each other and a broken build is never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.responses import path_exists


def fingerprint(tables: Mapping[str, DataFrame]) -> str:
    """Hex digest of the tables' names, columns and rows; one aggregate per table, independent of row order and partitions.

    Rows are told apart by two 64-bit hashes, summed as decimals with their number.
    """
    said = []
    for name in sorted(tables):
        df = tables[name]
        kinds = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        # a null hashes as if it were not there, so the places of nulls are hashed too
        cols = [F.col(f"`{c}`") for c, _ in kinds]
        cells = [*cols, F.concat(*[c.isNull().cast("int").cast("string") for c in cols])]
        wide = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
        got = df.agg(F.count(F.lit(1)).alias("n"), wide(F.xxhash64(*cells)).alias("a"), wide(F.xxhash64(F.lit(1), *cells)).alias("b")).first()
        said.append(repr((name, kinds, got["n"], got["a"], got["b"])))
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:32]


def _publish(spark: SparkSession, built: str, path: str) -> bool:
    """Renames a folder; False if another builder was first (its folder stays, ours is deleted)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (built, path))
    fs = source.getFileSystem(conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), conf) \
            .rename(source, target, options)
        return True
    except Exception:
        if not path_exists(spark, f"{path}/_SUCCESS"):
            raise
        fs.delete(source, True)
        return False


def grid_by_content(spark: SparkSession, root: str, tables: Mapping[str, DataFrame],
                    build: Callable[[Mapping[str, DataFrame]], DataFrame], fmt: str = "parquet") -> DataFrame:
    """The grid that ``build`` makes of the factor tables, read from ``root/grid-<fingerprint>`` or built there.

    A changed level, a changed text or a repeated row gives another name, so the grid
    is built anew; grids of earlier levels stay until they are deleted.
    """
    path = f"{root.rstrip('/')}/grid-{fingerprint(tables)}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        mine = f"{root.rstrip('/')}/.building-{uuid.uuid4().hex}"
        build(tables).write.format(fmt).save(mine)
        _publish(spark, mine, path)
    return spark.read.format(fmt).load(path)
