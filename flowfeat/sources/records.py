"""Readers and writers of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_records(spark: SparkSession, path: str, schema: StructType, array: bool = False) -> DataFrame:
    """A1: JSON lines, or one JSON array per file; the schema is given, blank lines are skipped."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A2: UTF-8 records, characters kept as they are; nulls are written as missing keys."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_shards(df: DataFrame, path: str, rows_per_file: int) -> DataFrame:
    """Files of at most so many rows, and their manifest (file, rows)."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
