"""Readers and writers at the edges (S1, S4, S6, S8, S9) and the report
frame (S7).  Stage hand-offs are parquet in the shared folder; CSV and JSON
only at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchlens.session import scratch_path
from patchlens.sources import ranged_csv

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


# S1
def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with quoted multi-line fields; empty fields read as null. A file is read by as many tasks as it has ranges."""
    return ranged_csv.read(spark, path, schema)


def csv_round_trip(df: DataFrame, name: str = "csv") -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema)


# S4
def count_lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines minus the header of every part file, next to the logical
    row count (they differ when quoted fields hold line breaks), in one scan."""
    return ranged_csv.count(spark, path)


# S6
def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def parquet_round_trip(df: DataFrame, name: str = "table") -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


# S9
def json_round_trip(df: DataFrame, name: str = "json") -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)
