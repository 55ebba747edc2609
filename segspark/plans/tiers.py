"""The tier merge: effective = (cold | adds) - removes, where the last operation on an id wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions.ids import chunk_key


def resolve(ops: DataFrame, *keys: str) -> DataFrame:
    """keys, id, add: the last operation on each id. seq is unique for each (keys, id)."""
    return ops.groupBy(*keys, "id").agg(F.max_by("add", "seq").alias("add"))


def effective(cold: DataFrame, ops: DataFrame | None, *keys: str) -> DataFrame:
    """keys, id. cold has distinct (keys, id); ops has keys, id, add, seq.

    One aggregation over the union of both: the cold tier is an add before all operations. Map-side
    aggregation collapses repeated operations before the exchange, and no join is needed.
    """
    if ops is None:
        return cold.select(*keys, "id")
    base = cold.select(*keys, "id", F.lit(True).alias("add"), F.lit(-1).cast("long").alias("seq"))
    rows = base.unionByName(ops.select(*keys, "id", "add", F.col("seq").cast("long").alias("seq")))
    return resolve(rows, *keys).where("add").select(*keys, "id")


def overlay(cold: DataFrame, ops: DataFrame, *keys: str) -> DataFrame:
    """The same for a small tail of operations over a large generation: the generation is not regrouped, only
    anti-joined with the touched ids, which adaptive execution broadcasts while they are small."""
    own, last = [*keys, "id"], resolve(ops, *keys)
    return cold.select(own).join(last.select(own), own, "left_anti").unionByName(last.where("add").select(own))


def dirty_chunks(ops: DataFrame, *keys: str) -> DataFrame:
    """keys, dirty: chunks with pending operations."""
    return ops.groupBy(*keys).agg(F.countDistinct(chunk_key()).alias("dirty"))
