"""Set algebra over tables with one column, id, that hold distinct ids and no nulls.

Everything is a semi join, an anti join or a distinct union on one long key, so Catalyst and adaptive execution
choose broadcast or sort-merge by the sizes they see, split skewed partitions and drop empty sides. Operands
are joined from the smallest on where their sizes are known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.errors import ValidationError


def _need(operands: Sequence[DataFrame], least: int, what: str) -> None:
    if len(operands) < least:
        raise ValidationError(f"{what} needs at least {least} operand(s)")


def union(operands: Sequence[DataFrame], exclude: Sequence[DataFrame] = ()) -> DataFrame:
    """Ids in any operand, without those in any exclude."""
    _need(operands, 1, "union")
    if len(operands) == 1:
        return suppress(operands[0], exclude)
    rows = reduce(DataFrame.unionByName, [o.select("id") for o in operands])
    # The anti join before the distinct would see repeats; after it, the exchange on id is shared.
    return suppress(rows.distinct(), exclude)


def intersect(operands: Sequence[DataFrame], exclude: Sequence[DataFrame] = (), sizes: Sequence[int] | None = None) -> DataFrame:
    """Ids in every operand, without those in any exclude; one operand is itself."""
    _need(operands, 1, "intersect")
    order = sorted(range(len(operands)), key=lambda i: sizes[i]) if sizes else range(len(operands))
    first, *rest = [operands[i].select("id") for i in order]
    return suppress(reduce(lambda a, b: a.join(b, "id", "left_semi"), rest, first), exclude)


def suppress(ids: DataFrame, exclude: Sequence[DataFrame]) -> DataFrame:
    """One anti join for each exclude: ids can only go."""
    return reduce(lambda a, b: a.join(b.select("id"), "id", "left_anti"), exclude, ids.select("id"))


def and_not(base: DataFrame, excludes: Sequence[DataFrame]) -> DataFrame:
    _need(excludes, 1, "and_not")
    return suppress(base, excludes)


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in one of two: a single aggregation, no join."""
    rows = a.select("id", F.lit(1).alias("side")).unionByName(b.select("id", F.lit(2).alias("side")))
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")


def and_or(base: DataFrame, any_of: Sequence[DataFrame]) -> DataFrame:
    """Ids of base that are in any of the others; the union needs no distinct under a semi join."""
    _need(any_of, 1, "and_or")
    others = reduce(DataFrame.unionByName, [o.select("id") for o in any_of])
    return base.select("id").join(others, "id", "left_semi")


def within_chunks(ids: DataFrame, keys: DataFrame, few: bool = True) -> DataFrame:
    """Only ids in the given chunks. There are few chunk keys, at most 65,536 of ids of 32 bits, so they are broadcast."""
    own = ids if "chunk_key" in ids.columns else ids.withColumn("chunk_key", F.shiftright("id", 16).cast("int"))
    keys = keys.select(F.col("chunk_key").cast("int"))
    return own.join(F.broadcast(keys) if few else keys, "chunk_key", "left_semi").select("id")


def has_batch(probes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, present for each distinct probe."""
    found = ids.select("id", F.lit(True).alias("_in"))
    return probes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("_in", F.lit(False)).alias("present"))


def pair_overlap(members: DataFrame, key: str = "segment") -> DataFrame:
    """a, b, n_common, n_a, n_b, jaccard for pairs of segments (a < b) with ids in common.

    Each id contributes the pairs of segments that hold it: the segments of an id are collected first, so the
    exchange carries one row for each id and the number of pairs is bounded by the number of segments.
    """
    sizes = members.groupBy(key).agg(F.count("*").alias("n"))
    lists = members.groupBy("id").agg(F.array_sort(F.collect_set(key)).alias("s"))
    a = lists.select("s", F.posexplode("s").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    common = pairs.groupBy("a", "b").agg(F.count("*").alias("n_common"))
    out = common.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("n_b")), "b")
    return out.withColumn("jaccard", F.round(F.col("n_common") / (F.col("n_a") + F.col("n_b") - F.col("n_common")), 6))
