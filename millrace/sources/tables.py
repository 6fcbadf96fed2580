"""The star schema's parquet tables, and file formats to write and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. The path is only ever opened by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Makes temporary views of the named tables, or of all."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
