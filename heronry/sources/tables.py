"""Readers for the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of ``directory``; columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def single_column_sorted(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of one column (null included once); only that column is read."""
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_first())
