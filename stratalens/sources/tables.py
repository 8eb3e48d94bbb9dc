"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables a data folder may hold.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "repositories files symbols nodes security_findings mix_targets"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned and filters pushed by whatever is built on it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: tuple[str, ...] | list[str]) -> None:
    """Registers tables as temporary views."""
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
