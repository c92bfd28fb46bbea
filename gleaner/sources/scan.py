"""Scans of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A scan. Where it would have fewer than ``partitions`` tasks (a table stored in few row groups), its rows are dealt
    out to so many; a larger table is read as it stands, without a shuffle."""
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions and df.rdd.getNumPartitions() < partitions else df
