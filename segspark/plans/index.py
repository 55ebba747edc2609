"""The chunk index: one row for each chunk of a segment, at most 65,536 a segment."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions.ids import chunk_key

#: A chunk's bytes in a portable bitmap: 2 an id, or a bitmap of 8 KiB.
CHUNK_BITMAP = 8192


def chunk_index(ids: DataFrame, *keys: str) -> DataFrame:
    """keys, chunk_key, cardinality, bytes, checksum of distinct ids. The checksum is a sum of hashes, so it
    doesn't depend on order and partial sums add up."""
    rows = ids.select(*keys, chunk_key().alias("chunk_key"), "id")
    out = rows.groupBy(*keys, "chunk_key").agg(F.count("*").alias("cardinality"), F.sum(F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("checksum"))
    return out.select(*keys, "chunk_key", "cardinality", F.least(2 * F.col("cardinality"), F.lit(CHUNK_BITMAP)).cast("long").alias("bytes"), "checksum")


def half_chunk_index(ids: DataFrame, *keys: str) -> DataFrame:
    return ids.groupBy(*keys, F.shiftright("id", 15).alias("half")).agg(F.count("*").alias("cardinality"))


def key_presence(indexes: Sequence[DataFrame]) -> DataFrame:
    """chunk_key, n: how many operands have the chunk."""
    rows = reduce(DataFrame.unionByName, [i.select("chunk_key").distinct() for i in indexes])
    return rows.groupBy("chunk_key").agg(F.count("*").alias("n"))


def common_keys(indexes: Sequence[DataFrame]) -> DataFrame:
    return key_presence(indexes).where(F.col("n") == len(indexes)).select("chunk_key")


def efficiency(indexes: Sequence[DataFrame]) -> DataFrame:
    """One row: chunks an intersection fetches, and those it skips."""
    k = len(indexes)
    return key_presence(indexes).agg(
        F.count_if(F.col("n") == k).alias("fetched"),
        F.count_if(F.col("n") < k).alias("skipped"),
    )


def combine_stats(indexes: Sequence[DataFrame], excludes: Sequence[DataFrame] = (), any_of: bool = False) -> DataFrame:
    """One row about a combination, from chunk keys alone: fetched and skipped chunks, and units, what a budget counts.

    For each key that is combined, units are the operands and the excludes that have it; an exclude never adds a key.
    """
    k = 1 if any_of else len(indexes)
    present = key_presence(indexes)
    if excludes:
        present = present.join(key_presence(excludes).select("chunk_key", F.col("n").alias("x")), "chunk_key", "left")
    touched = F.col("n") + (F.coalesce("x", F.lit(0)) if excludes else F.lit(0))
    return present.agg(
        F.count_if(F.col("n") >= k).alias("fetched"),
        F.count_if(F.col("n") < k).alias("skipped"),
        F.coalesce(F.sum(F.when(F.col("n") >= k, touched)), F.lit(0)).cast("long").alias("units"),
    )


def combine_units(indexes: Sequence[DataFrame], excludes: Sequence[DataFrame] = (), any_of: bool = False) -> DataFrame:
    return combine_stats(indexes, excludes, any_of).select("units")
