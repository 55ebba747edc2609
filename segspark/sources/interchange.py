"""Ids from and to other stores: lines of text, JDBC tables, Parquet. Object stores (s3a, gs, abfss) are paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.functions.ids import MAX_ID, MAX_WIDE_ID, guarded


def read_lines(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """One id a line; blank lines are nothing, others must be ids, of a wide store (below 2**47) if wide."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(guarded(F.trim("value").try_cast("long"), MAX_WIDE_ID if wide else MAX_ID).alias("id"))


def write_lines(ids: DataFrame, path: str) -> None:
    ids.select(F.col("id").cast("string").alias("value")).write.text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, partitions: int = 16, **options: str) -> DataFrame:
    """Ids of a column, read in ranges of the 32-bit domain side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound="0", upperBound=str(1 << 32), numPartitions=str(partitions), **options)
    return reader.load().select(guarded(F.col(column)).alias("id"))


def write_jdbc(ids: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    ids.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
