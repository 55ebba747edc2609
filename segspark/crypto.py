"""Sealing chunks with AES-256-GCM through Spark's built-in functions.

Each segment has a data key, kept only wrapped by one or more key-encryption keys. A chunk's associated data
binds it to namespace, segment, generation and chunk, so a sealed chunk moved elsewhere doesn't open. Losing all
wrapped copies of the data key makes every sealed chunk unreadable, which is what destroying a segment does.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.errors import KeyUnavailableError, ValidationError

MAX_WRAPPED = 8


def associated_data(namespace: str, segment: str, generation: Column, chunk: Column) -> Column:
    """Lengths go before names, so no two places have the same bytes."""
    return F.concat_ws("|", F.lit(f"{len(namespace)}:{namespace}"), F.lit(f"{len(segment)}:{segment}"), generation.cast("string"), chunk.cast("string"))


class Keyring:
    """Key-encryption keys by id. The first wraps and opens; all given ids wrap, so any one of them recovers."""

    def __init__(self, spark: SparkSession, keys: Mapping[str, bytes]):
        if not keys or len(keys) > MAX_WRAPPED or any(len(k) != 32 for k in keys.values()):
            raise ValidationError("1 to 8 keys of 32 bytes are needed")
        self.spark, self.keys = spark, dict(keys)

    def _run(self, c: Column) -> bytes | None:
        v = self.spark.range(1).select(c.alias("v")).first()["v"]
        return bytes(v) if v is not None else None

    def new_key(self) -> tuple[bytes, list[dict[str, str]]]:
        """A data key, and its wrapped copies as stored."""
        key = os.urandom(32)
        return key, self.wrap(key)

    def wrap(self, key: bytes) -> list[dict[str, str]]:
        return [{"key_id": i, "wrapped": self._run(F.aes_encrypt(F.lit(key), F.lit(k), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(i.encode()))).hex()} for i, k in self.keys.items()]

    def unwrap(self, copies: list[dict[str, str]]) -> bytes:
        for c in copies:
            if (k := self.keys.get(c["key_id"])) is not None:
                key = self._run(F.try_aes_decrypt(F.lit(bytes.fromhex(c["wrapped"])), F.lit(k), F.lit("GCM"), F.lit("DEFAULT"), F.lit(c["key_id"].encode())))
                if key is not None:
                    return key
        raise KeyUnavailableError("no key at hand opens the data key")

    def rotate(self, copies: list[dict[str, str]]) -> list[dict[str, str]]:
        """The same data key under this ring's keys; sealed chunks stay as they are."""
        return self.wrap(self.unwrap(copies))


def seal(chunks: DataFrame, key: bytes, namespace: str, segment: str) -> DataFrame:
    """generation, chunk_key, payload and any others: payload becomes sealed (nonce, ciphertext, tag)."""
    aad = associated_data(namespace, segment, F.col("generation"), F.col("chunk_key"))
    return chunks.withColumn("sealed", F.aes_encrypt(F.col("payload"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)).drop("payload")


def unseal(sealed: DataFrame, key: bytes, namespace: str, segment: str) -> DataFrame:
    """The payloads; the job fails on a chunk that was changed or belongs elsewhere."""
    aad = associated_data(namespace, segment, F.col("generation"), F.col("chunk_key"))
    opened = F.try_aes_decrypt(F.col("sealed"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad)
    return sealed.withColumn("payload", F.coalesce(opened, F.raise_error(F.lit("a sealed chunk doesn't open")).cast("binary"))).drop("sealed")
