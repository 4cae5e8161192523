"""Category lexicons: (token, category, ordinal) tables.

``ordinal`` keeps the order of files (by path) and of entries within a file,
which decides duplicate tokens (last wins).  ``.dic`` lexicons are written as
ordered part files and read by lines, so no task or row holds a whole lexicon;
a multi-line CSV file is read by one task, as the format demands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.report import global_row_number
from vigil.plans.sizing import bounded_broadcast
from vigil.session import materialize


def read_lexicon(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read a lexicon as CSV (``token,category`` header) or ``.dic``."""
    fmt = fmt or ("dic" if path.endswith(".dic") else "csv")
    if fmt == "dic":
        return read_dic_lexicon(spark, path)
    if fmt != "csv":
        raise ValueError(f"unknown lexicon format {fmt!r}")
    df = (spark.read.option("header", "true").option("multiLine", "true")
          .option("escape", '"').schema("token string, category string").csv(path))
    # a multi-line file is one task, so the id rises with its entries
    placed = df.select("token", "category", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("pos"))
    return global_row_number(placed, ["path", "pos"], "ordinal").select("token", "category", "ordinal")


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under ``path`` with their place: (path, block, line, value), written once.

    The text reader cuts at CR, LF and CRLF and splits large files; ``block`` is where
    a line's split begins and ``line`` rises within it, so (path, block, line) is the
    order of the file, whatever the splits.  Both numbers are checkpointed, because a
    recomputed scan may be planned into other tasks.
    """
    meta = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return materialize(spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("line"), "value"))


def read_dic_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Read the ``.dic`` format from one file, several files, or a folder of ordered parts.

    Layout: a ``%`` line, ``id<TAB>category`` lines, a ``%`` line, then
    ``token<TAB>id[<TAB>id...]`` lines.  Line ends may be CR, LF or CRLF.  The first
    two ``%`` lines of a file are its marks; a file without marks goes on with the
    entries of the marked file before it (by path), as the parts of ``write_dic_lexicon`` do.

    Entries whose id the header lacks are left out.  One row per file goes to the
    driver, which holds the list of files anyway; entries and headers stay distributed.
    """
    lines = _placed_lines(spark, path)
    at = F.struct("block", "line")
    marks = lines.where(F.trim("value") == "%").groupBy("path").agg(F.slice(F.array_sort(F.collect_list(at)), 1, 2).alias("m"))
    marked = {r["path"]: [tuple(x) for x in r["m"]] for r in marks.collect()}
    files, owner = [], None
    for file in sorted(r[0] for r in lines.select("path").distinct().collect()):
        owner = file if file in marked else owner
        if owner is not None:
            first, second = ([*marked.get(file, [(-1, -1), (-1, -1)]), (1 << 62, 0)])[:2]
            files.append((file, owner, first, second))
    spot = "struct<block:bigint,line:bigint>"
    where = spark.createDataFrame(files, f"path string, owner string, first {spot}, second {spot}")
    known = lines.join(F.broadcast(where), "path").withColumn("at", at)
    header = (known.where((F.col("at") > F.col("first")) & (F.col("at") < F.col("second")))
              .select("owner", F.split(F.trim("value"), "\t").alias("f")).where(F.size("f") >= 2)
              .select("owner", F.trim(F.col("f")[0]).alias("cat_id"), F.trim(F.col("f")[1]).alias("category")))
    entries = (known.where(F.col("at") > F.col("second")).select("owner", "path", "block", "line", F.split("value", "\t").alias("f"))
               .where(F.size("f") >= 2)
               .select("owner", "path", "block", "line", F.col("f")[0].alias("token"), F.posexplode(F.slice("f", 2, F.size("f"))).alias("k", "cat_id"))
               .withColumn("cat_id", F.trim("cat_id")))
    named = entries.join(bounded_broadcast(header), ["owner", "cat_id"])
    return global_row_number(named, ["path", "block", "line", "k"], "ordinal").select("token", "category", "ordinal")


def write_dic_lexicon(lexicon: DataFrame, path: str, line_end: str = "\n") -> None:
    """Write (token, category, ordinal) in the ``.dic`` layout as ordered part files.

    Entries are sorted by range over as many tasks as shuffle partitions (few, where
    they are small); the marks and the header, one line per category, open the first part.
    Entries of one ordinal are ordered by token and category.
    """
    cats = global_row_number(lexicon.select("category").where(F.col("category").isNotNull()).distinct(), ["category"], "cat_id")
    cats = bounded_broadcast(materialize(cats))
    none = F.lit(None).cast("long")
    head = cats.select(F.lit(1).alias("sec"), none.alias("pos"), F.col("cat_id").alias("k"),
                       F.concat_ws("\t", F.col("cat_id").cast("string"), "category").alias("value"))
    body = lexicon.where(F.col("token").isNotNull()).join(cats, "category").select(
        F.lit(3).alias("sec"), F.coalesce(F.col("ordinal").cast("long"), F.lit(-(1 << 63))).alias("pos"), F.col("cat_id").alias("k"),
        F.concat_ws("\t", "token", F.col("cat_id").cast("string")).alias("value"))
    marks = lexicon.sparkSession.createDataFrame([(0, None, 0, "%"), (2, None, 0, "%")], "sec int, pos long, k long, value string")
    lines = marks.unionByName(head).unionByName(body)
    # all marks and header lines share the null position, so one range, the first, has them
    lines = lines.repartitionByRange(F.asc_nulls_first("pos")).sortWithinPartitions("sec", "pos", "value", "k")
    lines.select("value").write.mode("overwrite").option("lineSep", line_end).text(path)
