"""The chunked bitmap container: one file a generation, read and written for interchange.

Eight bytes of preamble, chunk payloads (portable bitmaps of lower halves), an index of variable-length integers and a
footer of 104 bytes; little-endian. Storage itself uses Parquet, whose footers and page checksums do the same work.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.errors import IntegrityError, UnsupportedError, ValidationError
from segspark.functions.ids import CHUNK, MAX_WIDE_ID, guarded
from segspark.sources import roaring
from segspark.sources.files import written

# Fixed values of the format.
MAGIC, MAJOR, MINOR = b"CRBM", 1, 0
PREAMBLE, FOOTER, COVERED = 8, 104, 96
ENCRYPTED, LITTLE_ENDIAN = 1, 4
PORTABLE, ELEMENT_WIDTH, NO_CONTAINER_CODEC = 1, 32, 0
MAX_INDEX, MAX_PAYLOAD, MAX_CARDINALITY = 8 << 20, 16 << 20, 1 << 16
_FOOT = struct.Struct("<QQIIHBBBBHQ12s16s16sIQI4s")
_POLYNOMIAL = 0x82F63B78
#: What ids of a file have above 32 bits, in the file's name.
_HIGH = re.compile(r"/high(\d+)-\d+\.crbm$")


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (_POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


_CRC = _table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ c >> 8
    return c ^ 0xFFFFFFFF


def _put(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _get(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise IntegrityError("index cut short")
        b = data[at]
        n |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            return n, at


@dataclass(frozen=True)
class Entry:
    chunk_key: int
    offset: int
    length: int
    cardinality: int
    crc: int


def write(ids: np.ndarray, generation: int = 0) -> bytes:
    ids = np.unique(np.asarray(ids, np.int64))
    keys, first = np.unique(ids >> 16, return_index=True)
    bounds = [*first.tolist(), len(ids)]
    return write_chunks(((int(k), roaring.encode(ids[a:b] & 0xFFFF), b - a) for k, a, b in zip(keys, bounds, bounds[1:], strict=False)), generation)


def write_chunks(chunks: Iterator[tuple[int, bytes, int]], generation: int = 0) -> bytes:
    """(chunk key, payload, cardinality) with ascending keys."""
    body, index = bytearray(MAGIC + bytes([MAJOR, MINOR, 0, 0])), bytearray()
    last, end, n, total = -1, PREAMBLE, 0, 0
    for key, payload, card in chunks:
        if key <= last or key > 0xFFFF or not payload or not 1 <= card <= MAX_CARDINALITY:
            raise ValidationError(f"chunk {key} is out of order or out of bounds")
        index += _put(key - max(last, 0)) + _put(len(body) - end) + _put(len(payload)) + _put(card) + struct.pack("<I", crc32c(payload))
        body += payload
        last, end, n, total = key, len(body), n + 1, total + card
    head = _FOOT.pack(len(body), len(index), crc32c(index), LITTLE_ENDIAN, PORTABLE, ELEMENT_WIDTH, NO_CONTAINER_CODEC, MAJOR, MINOR, 0, generation, b"", b"", b"", n, total, 0, MAGIC)
    return bytes(body + index) + head[:COVERED] + struct.pack("<I", crc32c(head[:COVERED])) + MAGIC


class Container:
    """Checks footer, index and, on reading, each payload."""

    def __init__(self, data: bytes):
        if len(data) < PREAMBLE + FOOTER:
            raise IntegrityError("too small for a container")
        foot = data[-FOOTER:]
        at, size, crc, flags, codec, width, inner, major, minor, _, self.generation, _, _, _, n, total, own, magic = _FOOT.unpack(foot)
        if magic != MAGIC or data[:4] != MAGIC or crc32c(foot[:COVERED]) != own:
            raise IntegrityError("the footer is damaged")
        if major != MAJOR or flags & ~(ENCRYPTED | LITTLE_ENDIAN) or width != ELEMENT_WIDTH or codec != PORTABLE or inner != NO_CONTAINER_CODEC:
            raise UnsupportedError(f"version {major}.{minor}, flags {flags}, width {width}, codec {codec}")
        if flags & ENCRYPTED:
            raise UnsupportedError("encrypted containers can't be read without their keys")
        if size > MAX_INDEX or at < PREAMBLE or at + size != len(data) - FOOTER:
            raise IntegrityError("the index is out of bounds")
        index = data[at : at + size]
        if crc32c(index) != crc:
            raise IntegrityError("the index is damaged")
        self.data, self.entries = data, list(self._entries(index, at))
        if len(self.entries) != n or sum(e.cardinality for e in self.entries) != total:
            raise IntegrityError("the footer's counts contradict the index")

    @staticmethod
    def _entries(index: bytes, stop: int) -> Iterator[Entry]:
        at = key = 0
        end, first = PREAMBLE, True
        while at < len(index):
            dk, at = _get(index, at)
            do, at = _get(index, at)
            n, at = _get(index, at)
            card, at = _get(index, at)
            if at + 4 > len(index):
                raise IntegrityError("index cut short")
            crc = struct.unpack_from("<I", index, at)[0]
            at += 4
            if not first and dk == 0:
                raise IntegrityError(f"chunk {key} is there twice")
            key, offset, first = key + dk, end + do, False
            if key > 0xFFFF or not 0 < n <= MAX_PAYLOAD or not 1 <= card <= MAX_CARDINALITY or offset + n > stop:
                raise IntegrityError(f"chunk {key} is out of bounds")
            end = offset + n
            yield Entry(key, offset, n, card, crc)

    def count(self) -> int:
        return sum(e.cardinality for e in self.entries)

    def ids(self) -> np.ndarray:
        out = []
        for e in self.entries:
            payload = self.data[e.offset : e.offset + e.length]
            if crc32c(payload) != e.crc:
                raise IntegrityError(f"chunk {e.chunk_key} is damaged")
            low = roaring.decode(payload)
            if len(low) != e.cardinality:
                raise IntegrityError(f"chunk {e.chunk_key} contradicts the index")
            out.append(low + (e.chunk_key << 16))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, data in zip(f["path"], f["content"], strict=True):
            high = _HIGH.search(path)
            ids = Container(data).ids() + (int(high[1]) << 32 if high else 0)
            yield pd.DataFrame({"path": [path] * len(ids), "id": ids})


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, id of all container files under path, wide ids where write_files named them; the job fails on a damaged one."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_read, "path string, id long")


def write_files(ids: DataFrame, target: str, keys_per_file: int = 256, generation: int = 0) -> DataFrame:
    """path, ids of one container file for each range of chunk keys that has ids, at most 16 MiB each; ids are distinct.

    The format holds 32 bits. Ids beyond go without what is above into files whose names carry that, highHIGH-RANGE.crbm, each a
    container like any other; ids are below 2**47.
    """
    high, key = F.expr(f"int(chunk_key div {CHUNK})"), F.expr(f"int(chunk_key % {CHUNK})")
    place = F.format_string("%05d", F.expr(f"int(chunk_key % {CHUNK} div {keys_per_file})"))
    part = F.when(high == 0, place).otherwise(F.concat(F.format_string("high%05d-", high), place))
    chunks = roaring.encode_chunks(ids.select(guarded(F.col("id"), MAX_WIDE_ID).alias("id"))).select(part.alias("part"), key.alias("chunk_key"), "cardinality", "bitmap")
    chunks = chunks.repartition("part").sortWithinPartitions("part", "chunk_key")
    return written(chunks, target, ".crbm", lambda held: write_chunks(iter(held), generation), "part")
