"""Ids are integers in [0, 2**32), or in [0, 2**47) where a wide store or format says so. A chunk is 65,536 of them, named by
the upper half; half a chunk is one of Spark's built-in bitmaps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.errors import ValidationError

MAX_ID = (1 << 32) - 1
#: The largest of wide ids: their chunk keys are ints.
MAX_WIDE_ID = (1 << 47) - 1
CHUNK = 1 << 16


def check_id(value: int, most: int = MAX_ID) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most:
        raise ValidationError(f"not an unsigned {most.bit_length()}-bit id: {value!r}")
    return value


def split_id(value: int) -> tuple[int, int]:
    check_id(value)
    return value >> 16, value & 0xFFFF


def join_id(chunk_key: int, remainder: int) -> int:
    if not 0 <= chunk_key < CHUNK or not 0 <= remainder < CHUNK:
        raise ValidationError(f"not a place in a chunk: {chunk_key}, {remainder}")
    return (chunk_key << 16) | remainder


def chunk_key(c: Column | str = "id") -> Column:
    return F.shiftright(F.col(c) if isinstance(c, str) else c, 16).cast("int")


def remainder(c: Column | str = "id") -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit(0xFFFF)).cast("int")


def id_of(key: Column, rest: Column) -> Column:
    return key.cast("long") * CHUNK + rest


def in_domain(c: Column, most: int = MAX_ID) -> Column:
    """Whether a value is an id: not null and an unsigned 32-bit integer, or one up to most."""
    v = c.cast("long")
    return v.isNotNull() & v.between(0, most)


def guarded(c: Column, most: int = MAX_ID) -> Column:
    """The id as a long; the job fails on a null or on a value outside the domain."""
    v = c.cast("long")
    return F.when(in_domain(c, most), v).otherwise(F.raise_error(F.concat(F.lit(f"not an unsigned {most.bit_length()}-bit id: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("long"))


def id_frame(spark: SparkSession, ids: DataFrame | Iterable[int], column: str = "id", distinct: bool = True, most: int = MAX_ID) -> DataFrame:
    """One column, id, of valid ids (distinct ones, unless told otherwise), from a DataFrame or from Python integers."""
    if isinstance(ids, DataFrame):
        rows = ids.select(guarded(F.col(column), most).alias("id"))
        return rows.distinct() if distinct else rows
    rows = [(v,) for v in sorted({check_id(v, most) for v in ids})]
    return spark.createDataFrame(rows, "id long")
