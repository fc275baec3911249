"""Rows from JSON lines and CSV files: a declared schema, one pass, and what can't be read kept apart instead of lost.

Nothing is inferred, so that files are read once, and a column that a file lacks is null. A line that can't be read goes to _corrupt_record, with nulls for
what of it could not be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return schema if CORRUPT in schema.names else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A row a line."""
    return spark.read.schema(_with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Quotes inside quoted fields are doubled; fields may hold line ends; an empty quoted field is an empty text, an empty one (or \\N) null."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "header": str(header).lower(), "multiLine": "true", "escape": '"', "emptyValue": "", "nullValue": "\\N"}
    return spark.read.schema(_with_corrupt(schema)).options(**options).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(header="true", escape='"', emptyValue='""', quoteAll="false").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(path)


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, without the column, and those that could not. Spark does not read that column alone from files: select others with it, or store the rows first."""
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.where(F.col(CORRUPT).isNotNull())


def parsed_column(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """A JSON text column taken apart: its fields, and _corrupt_record where the text is no JSON of that schema."""
    parsed = F.from_json(column, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return rows.withColumn("_parsed", parsed).select(*rows.columns, "_parsed.*")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Parquet whose files have different columns: all columns of all files, null where a file lacks one."""
    return spark.read.option("mergeSchema", "true").parquet(path)
