"""Reading of the Parquet tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.plans.ship import shipped


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``, pruned to ``columns`` if any are named."""
    shipped(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
