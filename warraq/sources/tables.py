"""The Parquet tables of one scale directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
