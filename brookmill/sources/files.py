"""Readers and writers of file formats, by any path that Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table in files. Give a schema for json and csv: without one the files are read twice."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] = (), **options) -> None:
    """Write a table that isn't there yet."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    df.write.format(kind).options(**options).partitionBy(*partition_by).mode("errorifexists").save(path)
