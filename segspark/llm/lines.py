"""Line dedup: a sharded minimal perfect hash over the distinct lines' hashes, probed by the documents.

Line keys become two 64-bit hashes (XXH64, two seeds); (document, hashes) rows are written once and serve both
passes. Their counts are an aggregation with partial sums, so a line that is everywhere stays cheap. All distinct
hashes, whatever their count, are split into shards by hash; a shard is a minimal perfect hash that indexes three arrays:
a 32-bit fingerprint (of the second hash), the count of documents (32 bits, the largest number standing for all beyond), and
the document that keeps the line. About 17 bytes a line. Documents send 16-byte probes to the shards, never lines, and the
count found decides whether a line goes. Shards are sized by their keys, so their number grows with the lines, not the
documents. A shard with a hot line is copied, and its probes are dealt over the copies by document, so no task gets more than
a few times the mean. The list of such shards is broadcast: at most a quarter of the shards can be above four times the
mean, and there are at most MAX_SHARDS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import WHITE, ascii_lower, documents, read, stored
from segspark.llm.mph import PerfectHash

#: Lines of a shard, at most so many as there are (document, line) rows for each; and the most shards.
SHARD_ROWS, MAX_SHARDS = 1024, 1 << 20
MAX_COUNT = (1 << 32) - 1


class LineShard:
    """One shard: perfect hash, then fingerprint, count and keeper by slot."""

    def __init__(self, mph: PerfectHash, fingerprint: np.ndarray, count: np.ndarray, keeper: np.ndarray):
        self.mph, self.fingerprint, self.count, self.keeper = mph, fingerprint, count, keeper

    @staticmethod
    def _print(h2: np.ndarray) -> np.ndarray:
        return ((h2 ^ (h2 >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype("<u4")

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, keeper: np.ndarray) -> LineShard:
        h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        mph = PerfectHash.build(h1, h2)
        order = np.argsort(mph.lookup(h1, h2))
        return cls(mph, cls._print(h2)[order], np.minimum(count, MAX_COUNT).astype("<u4")[order], keeper.astype("<i8")[order])

    def to_bytes(self) -> bytes:
        return self.mph.to_bytes() + self.fingerprint.tobytes() + self.count.tobytes() + self.keeper.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> LineShard:
        mph, at = PerfectHash.from_bytes(data)
        return cls(mph, np.frombuffer(data, "<u4", mph.n, at), np.frombuffer(data, "<u4", mph.n, at + 4 * mph.n), np.frombuffer(data, "<i8", mph.n, at + 8 * mph.n))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and keeper of each key; count 0 where the fingerprint says it isn't in the shard."""
        h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        slot = self.mph.lookup(h1, h2)
        known = slot >= 0
        known[known] = self.fingerprint[slot[known]] == self._print(h2[known])
        at = np.where(known, slot, 0)
        return np.where(known, self.count[at], 0), self.keeper[at]


def _build_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard to one row per shard."""
    held: list[pd.DataFrame] = []

    def done() -> pd.DataFrame:
        x = pd.concat(held)
        blob = LineShard.build(*(x[c].to_numpy() for c in ("h1", "h2", "n", "keeper"))).to_bytes()
        return pd.DataFrame({"shard": [int(x["shard"].iloc[0])], "load": [int(x["n"].sum())], "blob": [blob]})

    for frame in frames:
        for shard, part in frame.groupby("shard", sort=False):
            if held and held[0]["shard"].iloc[0] != shard:
                yield done()
                held.clear()
            held.append(part)
    if held:
        yield done()


def _probe_shards(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _probed(batches, min_docs)

    return run


def _probed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and copy, the shard's arrays first, to the lines that documents lose."""
    index, here = None, None
    for b in batches:
        shard, salt, kind, h1, h2, doc = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        start, out = 0, []
        bounds = [*np.flatnonzero(kind == 0).tolist(), len(kind)]
        for stop in bounds:
            if stop > start and index is not None:
                own = slice(start, stop)
                mine = (shard[own] == here[0]) & (salt[own] == here[1])
                count, keeper = index.probe(h1[own], h2[own])
                go = mine & (count >= min_docs) & (keeper != doc[own])
                out.append((doc[own][go], h1[own][go]))
            if stop < len(kind):
                index, here = LineShard.from_bytes(b.column(6)[stop].as_py()), (shard[stop], salt[stop])
            start = stop + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc_id", "h1"])


def _drop_lines(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    hashed, white = xxhash.xxh64_intdigest, WHITE.encode()
    out = []
    for text, lost in zip(texts, drops, strict=True):
        rows = (text or "").encode().split(b"\n")
        kept = rows
        if lost is not None and len(lost):
            gone = {int(x) & (1 << 64) - 1 for x in lost}
            kept = [r for r in rows if hashed(r.strip(white).lower(), 42) not in gone]
        out.append((b"\n".join(kept).decode(), len(rows), len(rows) - len(kept)))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped, and carried; a row for each row of docs.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs documents lose all their lines but those of the largest doc_id
    that holds them. Null and empty texts have one empty line. Rows with the same id count as several
    documents towards min_docs, and keep or lose a line together; a null id is -1. Very long texts are split whole.
    Columns that aren't in carry are ignored, whatever their names. No rows give no rows.
    """
    d = documents(docs, carry)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda r: ascii_lower(F.trim(r, F.lit(WHITE))))
    keys = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    pairs = stored(d.select("doc_id", F.explode(keys).alias("k")).select("doc_id", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")), "lines")
    shards = min(MAX_SHARDS, max(1, -(-pairs.count() // SHARD_ROWS)))
    # Another mix than the partitions of rows by (h1, h2), so that shards take all of h1.
    pairs = pairs.withColumn("shard", F.pmod(F.xxhash64("h1"), F.lit(shards)))
    counted = pairs.groupBy("shard", "h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    index = stored(counted.repartition(n, "shard").sortWithinPartitions("shard").mapInPandas(_build_shards, "shard long, load long, blob binary"), "line-shards")
    # The mean over all shards; those far above it are copied.
    mean = max(64.0, (index.agg(F.sum("load")).first()[0] or 0) / shards)
    hot = index.where(F.col("load") > 4 * mean).select("shard", F.ceil(F.col("load") / (2 * mean)).alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    empty = [F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "doc_id")]
    arrays = index.join(F.broadcast(hot), "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"), F.lit(0).alias("kind"), *empty, "blob")
    probes = pairs.join(F.broadcast(hot), "shard", "left").select("shard", F.pmod(F.xxhash64("doc_id"), copies).alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "doc_id", F.lit(None).cast("binary").alias("blob"))
    lost = arrays.unionByName(probes).repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_probe_shards(min_docs), "doc_id long, h1 long")
    lost = lost.groupBy("doc_id").agg(F.collect_set("h1").alias("drops"))
    # Not deterministic to the optimiser, so it isn't run once for each column that is read.
    drop = F.pandas_udf(_drop_lines, "text string, n_lines long, n_dropped long").asNondeterministic()
    done = d.join(lost, "doc_id", "left").withColumn("done", drop("text", "drops"))
    return done.select("doc_id", "done.*", *(["carried"] if carry else []))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
