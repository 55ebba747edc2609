"""Token files: raw id payloads with a minimal perfect hash index from document keys to places.

Documents are range-partitioned by doc_id, so files in order hold them in ascending order. A shard is two
files in the shared folder:

    NAME.bin   the ids, one after another, little-endian, width bytes each; nothing else
    NAME.idx   "SGTI", version, width, records, distinct keys, levels, the levels' bits (u64 each); for each level of the perfect
               hash its words, each followed by the number of ones before it (u64, u64); in slot order fingerprint
               (u32) and first record (u32); in file order first id (u64, with one more for the end); then the
               records' keys (i64), which only whole reads of a shard look at

A key's slot is the perfect hash's value; its stored fingerprint tells other keys apart but for one in 2**32. Every place is
computed, so looking a key up reads the head of its shard's index once, then 16 bytes for each level tried (two on
average), 8 for the slot, 16 for the bounds and the ids themselves, whatever the number of documents. Files are written under
names with a random part and only those that a finished task reports are in the manifest, so a retried or doubled task
leaves files that nothing refers to. A shard is closed at SHARD_IDS ids, also between records of one key, so
neither memory nor the files depend on how many rows a partition or a key has; the manifest has one short row for each shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents, read, shared_dir
from segspark.llm.encode import default_path, encoder
from segspark.llm.mph import PerfectHash, key_pair

SHARD_IDS = 1 << 24
MAGIC, VERSION = b"SGTI", 2
_HEAD = struct.Struct("<4sHHQQQ")
#: Bytes read at first of an index, which hold its head; heads kept by keyed access.
HEAD_BYTES, MAX_HEADS = 1024, 4096
_MANIFEST = "part int, seq int, name string, width int, n_docs long, n_ids long, first_key long, last_key long"


def _open(path: str):
    """pyarrow's file system for a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)


def write_bytes(path: str, data: bytes) -> None:
    where, p = _open(path)
    with where.open_output_stream(p) as f:
        f.write(data)


def read_bytes(path: str) -> bytes:
    where, p = _open(path)
    with where.open_input_stream(p) as f:
        return f.read()


class Places:
    """Where the parts of an index lie, from its head."""

    def __init__(self, width: int, records: int, n: int, sizes: list[int]):
        self.width, self.records, self.n, self.sizes = width, records, n, sizes
        at, self.levels = _HEAD.size + 8 * len(sizes), []
        for size in sizes:
            self.levels.append(at)
            at += size // 4  # a word and its rank for each 64 bits
        self.slots, self.starts = at, at + 8 * n
        self.keys = self.starts + 8 * (records + 1)

    @classmethod
    def of(cls, data: bytes) -> Places:
        if len(data) < _HEAD.size:
            raise ValueError("not a token index")
        magic, version, width, records, n, levels = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token index")
        return cls(width, records, n, np.frombuffer(data, "<u8", levels, _HEAD.size).astype(int).tolist())


class ShardIndex:
    def __init__(self, width: int, mph: PerfectHash, fingerprint: np.ndarray, first: np.ndarray, keys: np.ndarray, starts: np.ndarray):
        self.width, self.mph, self.fingerprint, self.first, self.keys, self.starts = width, mph, fingerprint, first, keys, starts

    @staticmethod
    def _print(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return ((h1 ^ (h2 >> np.uint64(7))) & np.uint64(0xFFFFFFFF)).astype("<u4")

    @classmethod
    def build(cls, keys: np.ndarray, lengths: np.ndarray, width: int) -> ShardIndex:
        """keys ascending, repeats allowed; lengths in ids."""
        own, first = np.unique(keys, return_index=True)
        h1, h2 = key_pair(own)
        mph = PerfectHash.build(h1, h2)
        order = np.argsort(mph.lookup(h1, h2))
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        return cls(width, mph, cls._print(h1, h2)[order], first[order].astype("<u4"), keys.astype("<i8"), starts)

    def to_bytes(self) -> bytes:
        """The index's file."""
        mph = self.mph
        head = _HEAD.pack(MAGIC, VERSION, self.width, len(self.keys), mph.n, len(mph.sizes)) + np.array(mph.sizes, "<u8").tobytes()
        levels = [np.stack([w.astype("<u8"), r.astype("<u8")], axis=1).tobytes() for w, r in zip(mph.words, mph.ranks, strict=True)]
        slots = np.stack([self.fingerprint.astype("<u4"), self.first.astype("<u4")], axis=1).tobytes()
        return b"".join([head, *levels, slots, self.starts.tobytes(), self.keys.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        at = Places.of(data)
        words = [np.frombuffer(data, "<u8", size // 32, p).reshape(-1, 2)[:, 0] for size, p in zip(at.sizes, at.levels, strict=True)]
        slots = np.frombuffer(data, "<u4", 2 * at.n, at.slots).reshape(-1, 2)
        starts = np.frombuffer(data, "<u8", at.records + 1, at.starts)
        return cls(at.width, PerfectHash(at.n, at.sizes, words), slots[:, 0], slots[:, 1], np.frombuffer(data, "<i8", at.records, at.keys), starts)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 for keys that aren't in the shard."""
        h1, h2 = key_pair(keys)
        slot = self.mph.lookup(h1, h2)
        known = slot >= 0
        known[known] = self.fingerprint[slot[known]] == self._print(h1, h2)[known]
        return np.where(known, self.first[np.where(known, slot, 0)].astype(np.int64), -1) if self.mph.n else np.full(len(keys), -1)


def _write(folder: str, path: str, end_id: int, shard_ids: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], enc.kind).tobytes()
        keys: list[int] = []
        ids: list[bytes] = []
        seq = size = 0

        def close() -> pd.DataFrame:
            lengths = np.array([len(x) // enc.width for x in ids], np.int64)
            name = f"{folder}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}"
            write_bytes(name + ".bin", b"".join(ids))
            write_bytes(name + ".idx", ShardIndex.build(np.array(keys, np.int64), lengths, enc.width).to_bytes())
            return pd.DataFrame({"part": [part], "seq": [seq], "name": [name], "width": [enc.width], "n_docs": [len(keys)], "n_ids": [int(lengths.sum())], "first_key": [keys[0]], "last_key": [keys[-1]]})

        for f in frames:
            for at in range(0, len(f), 256):
                some = f.iloc[at : at + 256]
                for key, x in zip(some["doc_id"].tolist(), enc.encode([t or "" for t in some["text"]]), strict=True):
                    if size >= shard_ids:
                        yield close()
                        keys, ids, seq, size = [], [], seq + 1, 0
                    keys.append(key)
                    ids.append(x + end)
                    size += len(ids[-1]) // enc.width
        if keys:
            yield close()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> list:
    """Write all documents' files; the manifest's rows in file order (part, seq, name, width, n_docs, n_ids,
    first_key, last_key). Null texts are empty and hold the end id alone; a null doc_id is the key -1. Repeated ids
    stay as separate records one after another, of which keyed access finds the first; a key with very many
    rows is dealt over partitions by its texts' hashes. Other columns are ignored, whatever their names. No documents, no
    shards. A task holds one shard, so at most shard_ids ids and one text more.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = documents(docs).withColumn("place", F.xxhash64("text"))
    ranged = own.repartitionByRange(n, "doc_id", "place").sortWithinPartitions("doc_id", "place", "text")
    shards = ranged.select("doc_id", "text").mapInPandas(_write(folder, path or default_path(), end_id, shard_ids), _MANIFEST)
    return sorted(shards.collect(), key=lambda r: (r["part"], r["seq"]))


class TokenFiles:
    """Keyed access: the shard by its key range, then a few reads at computed places."""

    def __init__(self, manifest: list):
        self.manifest = [r for r in manifest if r["n_docs"]]
        self.lasts = np.array([r["last_key"] for r in self.manifest], np.int64)
        self._heads: dict[str, Places] = {}

    def _head(self, name: str, f) -> Places:
        if name not in self._heads:
            while len(self._heads) >= MAX_HEADS:
                self._heads.pop(next(iter(self._heads)))
            data = f.read_at(HEAD_BYTES, 0)
            self._heads[name] = Places.of(data)
        return self._heads[name]

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key's first record, end id included; None for a key that isn't there (or, for one absent key in
        2**32 within a shard's range, the ids of another)."""
        at = int(np.searchsorted(self.lasts, key))
        if at == len(self.lasts) or key < self.manifest[at]["first_key"]:
            return None
        name = self.manifest[at]["name"]
        where, p = _open(name + ".idx")
        h1, h2 = key_pair(np.array([key]))
        with where.open_input_file(p) as f:
            head, slot = self._head(name, f), None
            for level, (size, start) in enumerate(zip(head.sizes, head.levels, strict=True)):
                bit = int(PerfectHash._place(h1, h2, level, size)[0])
                word, rank = struct.unpack("<QQ", f.read_at(16, start + 16 * (bit >> 6)))
                if word >> (bit & 63) & 1:
                    slot = rank + (word & ((1 << (bit & 63)) - 1)).bit_count()
                    break
            if slot is None:
                return None
            fingerprint, record = struct.unpack("<II", f.read_at(8, head.slots + 8 * slot))
            if fingerprint != int(ShardIndex._print(h1, h2)[0]):
                return None
            a, b = struct.unpack("<QQ", f.read_at(16, head.starts + 8 * record))
        where, p = _open(name + ".bin")
        with where.open_input_file(p) as f:
            return np.frombuffer(f.read_at((b - a) * head.width, a * head.width), f"<u{head.width}")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for r in f.itertuples():
            index, data = ShardIndex.from_bytes(read_bytes(r.name + ".idx")), read_bytes(r.name + ".bin")
            if len(data) != r.n_ids * index.width:
                raise ValueError(f"{r.name}: {len(data)} bytes for {r.n_ids} ids")
            at = index.find(index.keys)
            if (index.keys[np.maximum(at, 0)] != index.keys).any() or (at < 0).any():
                raise ValueError(f"{r.name}: the index doesn't find its keys")
            # The record of a key, and its repeats after it.
            at = at + np.arange(len(at)) - np.searchsorted(index.keys, index.keys)
            starts = index.starts.astype(np.int64)
            for a in range(0, len(at), 1 << 12):
                some = at[a : a + (1 << 12)]
                ids = [np.frombuffer(data, f"<u{index.width}", starts[i + 1] - starts[i], starts[i] * index.width).astype("<u4").tobytes() for i in some]
                yield pd.DataFrame({"doc_id": index.keys[some], "start": r.base + starts[some], "n_tokens": starts[some + 1] - starts[some], "ids": ids})


def read_token_files(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), read from the files through their indexes."""
    base, rows = 0, []
    for r in manifest:
        rows.append((r["name"], r["n_ids"], base))
        base += r["n_ids"]
    table = spark.createDataFrame(rows, "name string, n_ids long, base long")
    return table.repartition(max(1, len(rows)), "name").mapInPandas(_read, "doc_id long, start long, n_tokens long, ids binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    where, p = _open(folder)
    where.create_dir(p, recursive=True)
    manifest = write_token_files(read(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
