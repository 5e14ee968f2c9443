"""Readers of the star-schema and text tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; the path is left to Spark, whatever store it names."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
