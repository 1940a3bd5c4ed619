"""The driver tables as DataFrames; Catalyst prunes columns and pushes filters into the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | tuple[str, ...]) -> None:
    """Temporary views for SQL plans, as the oracle names them."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
