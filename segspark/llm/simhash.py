"""SimHash near-dedup over vantage-point shards.

Fingerprints that differ in at most RADIUS = 3 of 64 bits differ in at most one bit of one 32-bit half. Each
half is searched by itself with radius 1. Vantage points: a fixed pattern seen through G disjoint bit masks of
the half gives every fingerprint G Hamming distances; a shard is one vector of distances. By the triangle
bound, fingerprints whose halves are one bit apart have vectors that differ by one in one place, so a
fingerprint is stored in its own shard and also queries the G shards that are one further in one distance.
G grows with the number of fingerprints (4, 8, 16), so shards stay small and copies few; a distance takes at least three
values. Shards fill unevenly, by the binomials and by texts that share much: one above SHARD_LIMIT entries is dealt over
pairs of blocks, stored entries of one against queries of another, so no task holds more than two blocks and no link is
lost.

Within a shard a vantage-point tree splits at the median distance from a fingerprint and prunes branches by
the triangle bound; leaves are compared directly on all 64 bits. Equal fingerprints are one entry. A shard
passes on a spanning forest of its links (at most one link per entry), not all pairs, so a dense group of
near copies stays linear; the components are the same. Distinct fingerprints near one another are bounded
by geometry (at most 43,745 within 3 bits of one), whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import cut, documents, read
from segspark.llm.components import components

RADIUS, HALF_RADIUS = 3, 1
# Fixed value: the vantage pattern, the golden ratio's bits.
VANTAGE = 0x9E3779B9
SHARD_TARGET = 2000
#: Entries of a shard that one task takes, and of a block of a larger one.
SHARD_LIMIT = 1 << 18
BRUTE = 1 << 18


def hashes(text: str | None, width: int = 3) -> np.ndarray:
    """The hash of each word shingle, repeats included; none for no words. A-Z are lower-cased, words split at ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    joined, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[width:]] + [len(joined)]
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))  # noqa: B905  one start a shingle


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of word shingles; 0 for no words."""
    return majority(hashes(text, width))


def _fingerprints(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(t, width) for t in f["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "fp": fp.view(np.int64)})

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); null and empty texts have fp 0."""
    return documents(docs).mapInPandas(_fingerprints(width), "doc_id long, fp long")


def spread(n: int) -> int:
    """Vantage masks a half for n fingerprints: the fewest whose shards hold SHARD_TARGET on average."""
    # The chance that two random halves share all distances, by number of masks.
    same = {4: 0.1964**4, 8: 0.2734**8}
    return next((g for g, p in same.items() if n * p <= SHARD_TARGET), 16)


def _shards(g: int):
    w = 32 // g
    masks = [np.uint64(((1 << w) - 1) << (i * w)) for i in range(g)]
    scale = [(w + 1) ** i for i in range(g)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy().view(np.uint64)
            for half in (0, 1):
                x = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)) ^ np.uint64(VANTAGE)
                d = [np.bitwise_count(x & m).astype(np.int64) for m in masks]
                home = sum(v * s for v, s in zip(d, scale, strict=True))
                # The shard number carries the half in its sign.
                name = lambda shard, half=half: shard if half else -1 - shard
                yield pd.DataFrame({"shard": name(home), "fp": f["fp"], "home": True})
                for v, s in zip(d, scale, strict=True):
                    ok = v < w
                    yield pd.DataFrame({"shard": name(home[ok] + s), "fp": f["fp"][ok], "home": False})

    return run


class Forest:
    """Union-find over 0..n-1 with whole-array steps."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = self.parent[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def search(fp: np.ndarray, home: np.ndarray, half: int, radius: int = RADIUS, half_radius: int = HALF_RADIUS, asking: np.ndarray | None = None) -> np.ndarray:
    """The forest roots of a shard's distinct fingerprints: links of stored ones (home) with those asking, by default all."""
    mask = np.uint64(0xFFFFFFFF << (32 * half))
    forest = Forest(len(fp))
    todo = [(np.flatnonzero(home), np.arange(len(fp)) if asking is None else np.flatnonzero(asking), True)]
    while todo:
        stored, asks, splits = todo.pop()
        if not len(stored) or not len(asks):
            continue
        if splits and len(stored) * len(asks) > BRUTE:
            at = fp[stored[len(stored) // 2]]
            ds, dq = (np.bitwise_count((fp[i] ^ at) & mask).astype(np.int64) for i in (stored, asks))
            cut_at = int(np.median(ds))
            near = ds <= cut_at
            if near.all():  # more than half lie on one distance: split below it
                cut_at -= 1
                near = ds <= cut_at
            useful = 0 < near.sum() < len(stored)
            todo.append((stored[near], asks[dq <= cut_at + half_radius], useful) if useful else (stored, asks, False))
            if useful:
                todo.append((stored[~near], asks[dq > cut_at - half_radius], True))
            continue
        rows = max(1, (1 << 22) // len(asks))
        for i in range(0, len(stored), rows):
            some = stored[i : i + rows]
            a, b = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[asks][None, :]) <= radius)
            a, b = some[a], asks[b]
            forest.link(a[a != b], b[a != b])
    return forest.roots()


def dealt(shards: DataFrame, limit: int) -> DataFrame:
    """shard, i, j, fp, home, asks: each shard as one group, or as groups of two blocks if it has more than limit rows.

    An entry of block b asks in all groups (i, b) and is stored, if it is at home, in all groups (b, j). The list of large
    shards is broadcast; it is shorter than the rows divided by limit.
    """
    full = cut(shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("shard", F.ceil(F.col("n") / limit).cast("int").alias("blocks")))
    if full.isEmpty():
        return shards.select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home", F.lit(True).alias("asks"))
    rows = shards.join(F.broadcast(full), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))

    def place(i, j, home, asks):
        return F.struct(i.alias("i"), j.alias("j"), home.alias("home"), asks.alias("asks"))

    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.when(o == own, F.array(place(own, own, F.col("home"), yes))).when(F.col("home"), F.array(place(o, own, no, yes), place(own, o, yes, no))).otherwise(F.array(place(o, own, no, yes))))
    return rows.select("shard", "fp", F.explode(F.flatten(at)).alias("at")).select("shard", "at.i", "at.j", "fp", "at.home", "at.asks")


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by group to the spanning links of each group."""
    held: list[tuple[np.ndarray, ...]] = []
    name: tuple[int, ...] = ()

    def done() -> pd.DataFrame:
        fp, home, asks = (np.concatenate(x) for x in zip(*held, strict=True))
        fp = fp.view(np.uint64)
        root = search(fp, home, int(name[0] >= 0), asking=asks)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[own].view(np.int64), "v": fp[root[own]].view(np.int64)})

    for f in frames:
        shard, i, j, fp, home, asks = (f[c].to_numpy() for c in ("shard", "i", "j", "fp", "home", "asks"))
        turns = np.flatnonzero((np.diff(shard) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        bounds = [0, *turns.tolist(), len(shard)]
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            if held and (shard[a], i[a], j[a]) != name:
                out.append(done())
                held.clear()
            name = (shard[a], i[a], j[a])
            held.append((fp[a:b], home[a:b], asks[a:b]))
        if out and len(links := pd.concat(out)):
            yield links
    if held and len(links := done()):
        yield links


def near_fingerprints(classes: DataFrame) -> DataFrame:
    """Links (u, v) of distinct fingerprints, column fp, at 3 or fewer differing bits: a spanning forest of each shard's, whose
    components are those of all links."""
    g = spread(classes.count())
    shards = classes.select("fp").mapInPandas(_shards(g), "shard long, fp long, home boolean")
    groups = dealt(shards, SHARD_LIMIT).repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return cut(groups.mapInPandas(_links, "u long, v long"))


def near_duplicates(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """doc_id, component_id and, without similarity, fp (signed long); one row for each row of docs.

    With a similarity, documents link at that Jaccard similarity of their shingles or more, which is checked on the
    shingles. Links of fingerprints propose pairs; they can't propose all (at 0.8 fingerprints differ in 10 bits on average
    and in up to 20, where unrelated texts lie too), so minima of the same shingle hashes propose the rest; the
    docstring of segspark.llm.similar has the cases. Without one, fingerprints at 3 or fewer differing bits link, those of texts without words (0) like any other;
    component_id is the smallest doc_id reachable over links. Null texts count as empty, a null id as -1; very long
    texts are read whole. Rows with the same id are in the component of each of their texts' smallest id. Other columns are
    ignored, whatever their names. No rows give no rows.
    """
    if similarity is not None:
        from segspark.llm.similar import similar_documents  # it uses this module's forest

        return similar_documents(docs, width, similarity)
    fps = cut(fingerprints(docs, width))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = near_fingerprints(classes)
    roots = cut(components(links).withColumnRenamed("node", "fp"))
    linked = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
