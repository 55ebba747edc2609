"""Half-chunk bitmaps: 32,768 bits each, Spark's built-in bitmap aggregates and counts.

Counts of intersections and differences come from bitmaps; the ids themselves come from joins, or from
expanding a bitmap in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF = 1 << 15


def to_bitmaps(ids: DataFrame, *keys: str) -> DataFrame:
    """keys, half, bits: one row for each half-chunk that has ids."""
    half, place = F.shiftright("id", 15).cast("int").alias("half"), F.col("id").bitwiseAND(F.lit(HALF - 1))
    return ids.select(*keys, half, place.alias("place")).groupBy(*keys, "half").agg(F.bitmap_construct_agg("place").alias("bits"))


def intersect_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, n: the size of the intersection of two bitmap tables.

    A half that only one side has must not count: bitmap_and_agg over one row is that row.
    """
    both = a.select("half", "bits").unionByName(b.select("half", "bits")).groupBy("half").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("k"))
    return both.where("k = 2").agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def union_bitmaps(*sides: DataFrame) -> DataFrame:
    all_rows = sides[0].select("half", "bits")
    for s in sides[1:]:
        all_rows = all_rows.unionByName(s.select("half", "bits"))
    return all_rows.groupBy("half").agg(F.bitmap_or_agg("bits").alias("bits"))


def and_not_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, n: |a| - |a and b|; there is no built-in and-not."""
    total = a.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("total"))
    return total.join(intersect_count(a, b).withColumnRenamed("n", "common")).select((F.col("total") - F.col("common")).alias("n"))


def _and_not(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        left = np.frombuffer(x, np.uint8)
        out.append(x if y is None else (left & ~np.frombuffer(y, np.uint8)).tobytes())
    return pd.Series(out)


def and_not_bits(a: Column, b: Column) -> Column:
    return F.pandas_udf(_and_not, "binary")(a, b)


def _expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for half, bits in zip(f["half"], f["bits"], strict=True):
            on = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
            yield pd.DataFrame({"id": on.astype(np.int64) + int(half) * HALF})


def expand(bitmaps: DataFrame) -> DataFrame:
    """The ids of a bitmap table."""
    return bitmaps.select("half", "bits").mapInPandas(_expand, "id long")
