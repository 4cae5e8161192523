"""S1 + E3 with row accounting: malformed records are set aside, and every row read is counted.

A CSV record that does not fit the schema (a wrong number of fields, or a field that is not
of its type) keeps its text in a corrupt-record column and is written to a quarantine; it
neither vanishes nor passes for a row with nulls.  Per file: rows in = kept + incomplete +
quarantined, from one aggregate over the rows that were kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigil.operators.extract import extract_answer_reason, reason_column
from vigil.session import materialize
from vigil.sources.responses import CSV_OPTIONS

RECORD, FILE, STATUS = "malformed_record", "source_file", "row_status"
KEPT, INCOMPLETE, QUARANTINED = "kept", "incomplete", "quarantined"


def scan_checked(spark: SparkSession, path: str, schema: StructType | str, base_path: str | None = None, header: bool = True,
                 multi_line: bool = True) -> DataFrame:
    """CSV rows with ``source_file`` and ``malformed_record`` (the record's text, or null if it fits the schema)."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = StructType([*kind.fields, StructField(RECORD, StringType())])
    # all fields are parsed whatever is selected, else a record's fit would depend on the query
    options = {**CSV_OPTIONS, "header": str(header).lower(), "multiLine": str(multi_line).lower(), "columnPruning": "false",
               "columnNameOfCorruptRecord": RECORD}
    reader = spark.read.options(**options).schema(kind)
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.csv(path).withColumn(FILE, F.col("_metadata.file_path"))


def with_status(scanned: DataFrame, col: str = "response") -> DataFrame:
    """Extracted rows with ``row_status``: quarantined, incomplete (no answer or reason) or kept; written once."""
    x = extract_answer_reason(scanned, col)
    whole = F.col("answer").isNotNull() & F.col(reason_column(x)).isNotNull()
    status = F.when(F.col(RECORD).isNotNull(), QUARANTINED).when(whole, KEPT).otherwise(INCOMPLETE)
    return materialize(x.withColumn(STATUS, status))


def kept_rows(checked: DataFrame) -> DataFrame:
    """What E3 keeps."""
    return checked.where(F.col(STATUS) == KEPT).drop(RECORD, FILE, STATUS)


def write_quarantine(checked: DataFrame, path: str) -> None:
    """Appends the malformed records with their files."""
    checked.where(F.col(STATUS) == QUARANTINED).select(FILE, RECORD).write.mode("append").parquet(path)


def account(checked: DataFrame, *keys: str) -> DataFrame:
    """Row counts per file (or ``keys``): rows_in, kept, incomplete, quarantined."""
    count = lambda s: F.count_if(F.col(STATUS) == s).alias(s)
    return checked.groupBy(*(keys or (FILE,))).agg(F.count(F.lit(1)).alias("rows_in"), count(KEPT), count(INCOMPLETE), count(QUARANTINED))
