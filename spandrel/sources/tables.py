"""Readers for the Parquet tables an estate is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spandrel.sources.shipping import ship


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """One table under ``root``; with ``columns`` only these are read (the scan prunes the rest)."""
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
