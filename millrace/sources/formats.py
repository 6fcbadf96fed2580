"""Writing a table in a file format and reading it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json")


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None) -> None:
    """Overwrites path. CSV gets a header."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; one of {', '.join(FORMATS)}")
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """Reads path; schema saves CSV and JSON from a pass over all rows to infer one."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)
