"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir`` as a lazy scan (filters and columns are pushed into it)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
