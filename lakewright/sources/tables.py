"""Parquet sources: the tables of a folder as DataFrames and as temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The relational tables of a data folder.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the folder's tables; a view reads only the columns and row groups a query needs."""
    for name in names:
        load(spark, folder, name).createOrReplaceTempView(name)
