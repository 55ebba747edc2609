"""Near copies by the Jaccard similarity of word shingles, for simhash.near_duplicates with a similarity: SimHash over
vantage-point shards and, for what it can't reach, MinHash bands propose pairs, the shingles decide.

Entries with equal fingerprints, and those whose fingerprints the shards link at 3 or fewer bits, are proposed first. A document is the set of 64-bit hashes of its shingles; equal sets are one entry. BANDS band keys of ROWS minima each
go with an entry; two entries are compared if they share a band and their sizes allow the similarity. A pair
at a similarity of 0.8 shares none with a chance of (1 - 0.8 ** 4) ** 32 < 5e-8, one above it less. (Fingerprint
bits can't propose these pairs: alone can't propose all these pairs: at 0.8 they differ in 10 of 64 on average, in up to 20 at times, and unrelated texts come as near.)

Bands are searched in two rounds. First every entry is compared with the smallest entry of each of its bands, so
a large group of near copies takes a row an entry and band, not all pairs. Then in bands whose entries are still in
different components all are compared with one another, so no pair is left out: a task takes a band, or two blocks of
a large one, and passes on a spanning forest of its links, not pairs. Bands with the same entries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import cut, documents, release, stored
from segspark.llm.components import components
from segspark.llm.simhash import Forest, hashes, majority, near_fingerprints

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Shingles hashed at a time; entries of a band in one block.
BLOCK, ENTRIES = 1 << 12, 1500


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted different hashes of word shingles; none for no words. They are those of simhash.fingerprint."""
    return np.unique(hashes(text, width))


def set_key(s: np.ndarray) -> int:
    """A name for the set as a signed long; 0 for no shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64)) if len(s) else 0


def _maps() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    a, b = (rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) for _ in range(2))
    return a | np.uint32(1), b


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the maps a * x + b of 32 bits."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), BLOCK):
        v = x[i : i + BLOCK] * a
        v += b
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """Rows of minima to rows of band keys (signed longs); the band's number is mixed in."""
    m = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    k = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), m.shape[:2]).copy()
    for i in range(ROWS):
        k = (k ^ m[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
        k *= np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(32)
    return k.view(np.int64)


def _entries(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _maps()
        for f in frames:
            keys, fps, sizes, least = [], [], [], np.zeros((len(f), BANDS * ROWS), np.uint32)
            for i, t in enumerate(f["text"]):
                h = hashes(t, width)
                s = np.unique(h)
                fps.append(majority(h))
                keys.append(set_key(s))
                sizes.append(len(s))
                least[i] = minima(s, a, b)
            yield pd.DataFrame({"doc_id": f["doc_id"], "key": keys, "fp": np.array(fps, np.uint64).view(np.int64), "n": sizes, "bands": list(band_keys(least))})

    return run


def _sets(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = [shingles(t, width) for t in f["text"]]
            yield pd.DataFrame({"key": [set_key(x) for x in s], "shingles": [x.tobytes() for x in s]})

    return run


def jaccard(a: bytes, b: bytes) -> float:
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _similar(similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[jaccard(a, b) >= similarity for a, b in zip(f["a"], f["b"], strict=True)], ["u", "v"]]

    return run


def search(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> np.ndarray:
    """Forest roots of the entries after links of similar ones; those with equal roots are linked already."""
    forest = Forest(len(sets))
    _, first, group = np.unique(roots, return_index=True, return_inverse=True)
    forest.link(np.arange(len(sets)), first[group])
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, local, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.split(owner[np.argsort(local, kind="stable")], np.cumsum(count)[:-1])
    own = np.split(local, np.cumsum(n)[:-1])
    for i, shared in enumerate(own):
        both = np.bincount(np.concatenate([holders[k] for k in shared]), minlength=len(sets))
        like = np.flatnonzero(both / (n + n[i] - both) >= similarity)
        forest.link(np.full(len(like), i), like)
    return forest.roots()


def _forests(similarity: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by group to the spanning links of each group."""
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            f = pd.concat(held)
            held.clear()
            key = f["key"].to_numpy()
            up = search([np.frombuffer(x, np.uint64) for x in f["shingles"]], f["root"].to_numpy(), similarity)
            own = np.flatnonzero(up != np.arange(len(key)))
            return pd.DataFrame({"u": key[own], "v": key[up[own]]})

        for f in frames:
            for _, part in f.groupby(["band", "i", "j"], sort=False):
                if held and tuple(held[-1][["band", "i", "j"]].iloc[0]) != tuple(part[["band", "i", "j"]].iloc[0]):
                    yield done()
                held.append(part)
        if held:
            yield done()

    return run


def _read_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """key, shingles of these keys. Only their texts are read again."""
    asked = cut(classes.join(keys.distinct(), "key", "left_semi").select("key", "least"))
    texts = documents(docs).join(asked.select(F.col("least").alias("doc_id")), "doc_id", "left_semi")
    return stored(texts.mapInPandas(_sets(width), "key long, shingles binary").join(asked.select("key"), "key", "left_semi").dropDuplicates(["key"]), "shingles")


def _star(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of keys whose shingles are similar."""
    sets = _read_sets(docs, classes, pairs.select(F.col("u").alias("key")).union(pairs.select("v")), width)
    a = sets.select(F.col("key").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("key").alias("v"), F.col("shingles").alias("b"))
    return cut(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInPandas(_similar(similarity), "u long, v long"))


def _rest(docs: DataFrame, classes: DataFrame, placed: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """Links between entries (band, key, root) of different components in a band; None if no band has such."""
    mark = [F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("key")).alias("mark")]
    split = placed.groupBy("band").agg(*mark).where("low <> high").groupBy("members", "mark").agg(F.min("band").alias("band"))
    left = cut(placed.join(split.select("band", "members"), "band"))
    if left.isEmpty():
        return None
    # A row goes to all groups of two blocks that hold its own; a band of one block is one group.
    blocks = F.ceil(F.col("members") / ENTRIES).cast("int")
    dealt = left.withColumn("g", blocks).withColumn("own", F.pmod(F.xxhash64("key"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    groups = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "root")
    rows = groups.join(_read_sets(docs, classes, left.select("key"), width), "key").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return cut(rows.mapInPandas(_forests(similarity), "u long, v long"))


def _fits(m, n, similarity: float):
    """Whether sets of m and n shingles can be as similar."""
    return F.least(m, n) / F.greatest(m, n) >= F.lit(similarity)


def fingerprint_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of keys that SimHash proposes, of sizes that allow the similarity: entries (key, n, fp) with the smallest key
    of their fingerprint, and these with one another where fingerprints link."""
    worded = classes.where("n > 0").select("key", "n", "fp")
    firsts = cut(worded.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("first")))
    u, v = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_first")) for x in "uv")
    equal = worded.join(firsts, "fp").where(F.col("key") != F.col("first.key")).select("first", F.struct("key", "n").alias("other"))
    linked = near_fingerprints(firsts).join(u, "u").join(v, "v").select(F.col("u_first").alias("first"), F.col("v_first").alias("other"))
    pairs = equal.union(linked).where(_fits(F.col("first.n"), F.col("other.n"), similarity))
    return pairs.select(F.least("first.key", "other.key").alias("u"), F.greatest("first.key", "other.key").alias("v"))


def similar_documents(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id; one row for each row of docs.

    Documents whose sets of shingles of width words have at least this Jaccard similarity link; fewer words are one
    shingle, and texts without words link with one another. component_id is the smallest doc_id reachable over links. Null
    texts count as empty, a null id as -1; very long texts are read whole, and a pair at exactly this similarity links. Rows
    with the same id are in the component of each of their texts' smallest id. Other columns are ignored, whatever their
    names. No rows give no rows. Below 0.8 more pairs share no band: at 0.7 a chance of 2e-4.
    """
    rows = stored(documents(docs).mapInPandas(_entries(width), "doc_id long, key long, fp long, n int, bands array<long>"), "bands")
    classes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    entries = classes.where("n > 0").select(F.explode("bands").alias("band"), "key", "n")
    hubs = entries.groupBy("band").agg(F.min(F.struct("key", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = cut(entries.join(hubs, "band").select("band", "key", "n", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")))
    banded = shared.where((F.col("key") != F.col("hub")) & _fits(F.col("n"), F.col("hub_n"), similarity)).select(F.col("hub").alias("u"), F.col("key").alias("v"))
    first = cut(fingerprint_pairs(classes, similarity).union(banded).distinct())
    release(docs.sparkSession)
    links = _star(docs, classes, first, width, similarity)
    roots = cut(components(links))
    placed = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    rest = _rest(docs, classes, placed, width, similarity)
    if rest is not None:
        roots = cut(components(links.union(rest)))
    linked = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "key").join(linked.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
