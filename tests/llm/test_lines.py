from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from segspark.llm import lines
from segspark.llm.mph import PerfectHash, key_pair

SCHEMA = "doc_id long, text string"
LONG = "a line that is long enough"


def brute(rows: list[tuple[int, str | None]], min_chars=20, min_docs=3) -> dict[int, tuple[int, int, str]]:
    white = "\t\n\x0b\x0c\r "
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda r: r.strip(white).translate(low)
    held = defaultdict(set)
    for d, t in rows:
        for r in (t or "").split("\n"):
            if len(key(r)) >= min_chars:
                held[key(r)].add(d)
    out = {}
    for d, t in rows:
        rs = (t or "").split("\n")
        kept = [r for r in rs if len(held.get(key(r), ())) < min_docs or max(held[key(r)]) == d]
        out[d] = (len(rs), len(rs) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_perfect_hash(n):
    h1, h2 = key_pair(np.arange(n) * 7 - 3)
    mph, size = PerfectHash.from_bytes(PerfectHash.build(h1, h2).to_bytes())
    assert sorted(mph.lookup(h1, h2).tolist()) == list(range(n))
    if n >= 1000:
        assert size * 8 / n < 6
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def test_shard_tells_strangers_apart():
    h = np.arange(500, dtype=np.int64) * 977
    shard = lines.LineShard.from_bytes(lines.LineShard.build(h, -h, np.full(500, 4), h).to_bytes())
    count, keeper = shard.probe(np.concatenate([h, h + 1]), np.concatenate([-h, -h - 1]))
    assert count.tolist() == [4] * 500 + [0] * 500 and keeper[:500].tolist() == h.tolist()


def test_cases(spark):
    rows = [
        (1, LONG), (2, f"x\n  {LONG.upper()}\t\n{LONG}"), (3, f"{LONG}\n{LONG}\nend"), (4, None), (5, ""), (6, "é" * 20), (7, "é" * 20), (8, "É" * 20),
        (9, "short\nshort"), (10, "short"), (11, "short"), (12, "\n\n"), (13, "Z" * 19), (14, "Z" * 19), (15, "Z" * 19), (16, " " + LONG), (17, "é" * 20),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).withColumn("drops", F.lit(1)).repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(df).collect()}
    assert got == brute(rows)
    assert got[2] == (3, 2, "x") and got[3] == (3, 0, f"{LONG}\n{LONG}\nend") and got[4] == (1, 0, "")


def test_a_hot_line_is_dealt_out(spark):
    rows = [(i, f"{LONG}\n{'only in %06d and nowhere else' % i}\n{'shared by four of them %05d' % (i // 4)}") for i in range(6000)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    got = lines.dedup_lines(spark.createDataFrame([(1, LONG), (1, LONG), (2, LONG), (None, LONG)], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(-1, 1), (1, 1), (1, 1), (2, 0)]


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in lines.op2(spark, sf).collect()}
    assert got == {d: (a, b, hashlib.sha256(t.encode()).hexdigest()) for d, (a, b, t) in brute(rows).items()}
