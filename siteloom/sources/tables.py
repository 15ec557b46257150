"""Readers of the captured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, narrowed to `columns` (so that the scan reads only those)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, key: str) -> DataFrame:
    """Exact repeats of a row count once: one row per `key`, rows with a null key are left out.

    Repeats carry equal values in every column, so any of them may stand for the rest.
    """
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])
