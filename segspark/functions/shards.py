"""Which of n workers a segment belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segspark.errors import ValidationError

# Fixed values of FNV-1a with 32 bits.
_OFFSET, _PRIME = 2166136261, 16777619


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _PRIME) & 0xFFFFFFFF
    return h


def shard_of(namespace: str, segment: str, shards: int) -> int:
    if shards < 1:
        raise ValidationError("shards must be 1 or more")
    return fnv1a(f"{namespace} {segment}".encode()) % shards


def shard_column(namespace: Column, segment: Column, shards: int) -> Column:
    """FNV-1a over the UTF-8 bytes, as a column: the fold runs over the hex digits of the key."""
    digits = F.hex(F.concat_ws(" ", namespace, segment).cast("binary"))
    octets = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(octets, F.lit(_OFFSET).cast("long"), lambda a, b: (a.bitwiseXOR(b) * F.lit(_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.pmod(h, F.lit(shards))
