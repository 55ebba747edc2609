from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from segspark.llm import simhash
from segspark.llm.components import components

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text: str | None) -> int:
    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [b" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(fps: dict[int, int]) -> dict[int, int]:
    ids = sorted(fps)
    v = np.array([fps[i] for i in ids], np.uint64)
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    return roots(((ids[i], ids[j]) for i, j in zip(a, b, strict=True)), ids)


def test_fingerprints():
    rng = random.Random(1)
    for text in (None, "", " \t\x0b", "One", "one two", "A b\x0cC d\x1ce", "é É  x y", *(" ".join(rng.choices("ab cd ef É g".split(), k=n)) for n in (3, 4, 50, 70_000))):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_vantage_shards_find_every_link(spark):
    """Random fingerprints, planted neighbours at 1 to 4 bits, a dense ball; all numbers of masks."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 500, np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, False)) for b in base[:240] for k in [int(rng.integers(1, 5))]]
    ball = [int(base[300]) ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    values = sorted({*base.tolist(), *near, *ball, 0, 7, (1 << 64) - 1})
    want = brute(dict(enumerate(values)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    for g, limit in ((4, 1 << 18), (8, 1 << 18), (16, 1 << 18), (4, 5), (8, 2)):  # the last two in blocks
        shards = df.mapInPandas(simhash._shards(g), "shard long, fp long, home boolean")
        groups = simhash.dealt(shards, limit)
        assert limit > 5 or groups.where("i <> j").count() > 0
        assert groups.groupBy("shard", "i", "j").count().agg({"count": "max"}).first()[0] <= max(limit * 4, 200)
        links = groups.repartition(4, "shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInPandas(simhash._links, "u long, v long").collect()
        at = {v: i for i, v in enumerate(values)}
        own = roots(((at[r["u"] & (1 << 64) - 1], at[r["v"] & (1 << 64) - 1]) for r in links), range(len(values)))
        assert own == want, (g, limit)


def test_tree_prunes_and_is_exact(monkeypatch):
    monkeypatch.setattr(simhash, "BRUTE", 64)
    rng = np.random.default_rng(3)
    high = np.uint64(0xABCDEF01 << 32)
    fp = np.unique(np.concatenate([high | rng.integers(0, 1 << 32, 400, np.uint64), high | (np.uint64(1) << rng.integers(0, 20, 300).astype(np.uint64))]))
    got = simhash.search(fp, np.ones(len(fp), bool), 1)
    want = brute(dict(enumerate(fp.tolist())))
    assert {i: int(r) for i, r in enumerate(got)} == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (7, 7), (200, 200), (-3, 100)]
    df = spark.createDataFrame([*pairs, (None, 1)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == roots(pairs, {x for p in pairs for x in p})
    assert components(df.where("false")).count() == 0


def test_cases(spark):
    rows = [(5, "a b c d"), (3, "A  B\tc d"), (9, None), (8, ""), (7, "  "), (1, "other words here now"), (None, "a b c d"), (3, "A B c d")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("clash"))
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (1, 1), (3, -1), (3, -1), (5, -1), (7, 7), (8, 7), (9, 7)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fps = {d: slow_fingerprint(t) for d, t in rows}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3(spark, sf).collect()}
    assert got == {d: (f"{fps[d]:016x}", c) for d, c in brute(fps).items()}
    assert len({c for _, c in got.values()}) < len(got)
