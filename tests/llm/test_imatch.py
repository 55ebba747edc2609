from __future__ import annotations

import hashlib
import math
import random
import struct
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from segspark.llm import imatch

SCHEMA = "doc_id long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_edited_texts_and_likeness(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in imatch.op8(spark, sf).collect()}
    prints = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 2
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), sha(t[: len(t) - k] + nxt[:k]))
        assert prints.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.93 * len(got)
    assert sum(r["near_next"] for r in got.values()) / len(got) < 0.02


def test_cases(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(60)] + [(100, None), (101, ""), (102, "!!"), (103, "x"), (104, "x"), (None, "é"), (104, "w")]
    rows += [(200, rows[0][1]), (201, " ".join(reversed(rows[0][1].split())))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rare", F.lit("clash"))
    all_rows = imatch.compare_edited(df).collect()
    assert len(all_rows) == len(rows) and sorted(r["n_chars"] for r in all_rows if r["doc_id"] == 104) == [1, 1]
    got = {r["doc_id"]: r for r in all_rows}
    x = [r["fingerprint"] for r in all_rows if r["doc_id"] in (103, 104)]
    assert sorted(x.count(f) for f in set(x)) == [1, 2]  # "x" twice and "w", under one id or not
    assert got[0]["fingerprint"] == got[200]["fingerprint"] == got[201]["fingerprint"]
    assert got[100]["fingerprint"] == got[101]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values())
    assert all(r["fingerprint"] for r in got.values())
    assert imatch.compare_edited(df.where("false")).count() == 0
    one = imatch.compare_edited(df.where("doc_id = 5")).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == sha(rows[5][1][: len(rows[5][1]) - len(rows[5][1]) // 2] + rows[5][1][: len(rows[5][1]) // 2])


def test_band(spark):
    rows = [(i, f"everywhere own{i} pair{i // 2}") for i in range(100)]
    band = imatch.Band(imatch._rows(spark.createDataFrame(rows, SCHEMA)))
    h = {r["w"]: r["h"] for r in spark.createDataFrame([("everywhere",), ("own7",), ("pair3",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert spark.range(1).select(band.frequent.alias("f")).first()["f"] == [h["everywhere"]]
    rare = {r["row"]: r["rare"] for r in band.rare.collect()}
    assert rare[7] == [h["own7"]] and len(rare) == 100


def test_many_frequent_terms_take_the_join(spark, monkeypatch):
    rows = [(i, f"everywhere also here own{i} pair{i // 2}") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in imatch.compare_edited(df).collect())
    monkeypatch.setattr(imatch, "MAX_FREQUENT", 2)
    assert sorted(tuple(r) for r in imatch.compare_edited(df).collect()) == want


def xx(data: bytes, seed: int = 42) -> int:
    h = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def slow(texts: list[str], extra: list[tuple[int, int, str]] = ()) -> tuple[list[str], list[str]]:
    """Fingerprints of all texts, and of edited texts (row, next row, text), by sets and dictionaries."""
    own = [{xx(w.encode()) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w} for t in texts]
    df = Counter(t for ts in own for t in ts)
    often = {t for t, n in df.items() if n >= imatch.MIN_DOCS and n > imatch.MAX_SHARE * len(texts)}
    rare = {t for t, n in df.items() if n < imatch.MIN_DOCS}

    def fingerprint(text: str, outside: set[int]) -> str:
        ts = {xx(w.encode()) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
        ts = (ts - outside) or ts or {xx(text.encode(), xx(b"text"))}
        out = ""
        for level in range(imatch.LEVELS):
            for part in range(imatch.PARTS):
                inside = [t & (1 << 64) - 1 for t in ts]
                inside = [t for t in inside if t % (1 << 2 * level) == 0 and t >> (60 - 4 * level) & 15 == part]
                h = 0
                for code in sorted((level * 16 + part) << 52 | t & (1 << 52) - 1 for t in inside):
                    h = xx(struct.pack("<q", code), xx(struct.pack("<q", h)))
                if inside:
                    out += f"{level * 16 + part:03X}{h & 0xFFFFFFFF:08X}"
        return out

    return [fingerprint(t, often | rare) for t in texts], [fingerprint(t, often | (rare & (own[a] | own[b]))) for a, b, t in extra]


def alike(a: str, b: str) -> float:
    x, y = ({f[i : i + 3]: f[i + 3 : i + 11] for i in range(0, len(f), 11)} for f in (a, b))
    return sum(x.get(k) == v for k, v in y.items()) / max(1, len(x.keys() | y.keys()))


@pytest.mark.parametrize("n", [1, 3, 39, 40, 120])
def test_against_brute_force(spark, n):
    """Fingerprints and both likenesses, at sizes on both sides of where the band starts to take terms."""
    rng = random.Random(n)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(60)] + ["the", "Éa", "é9"]
    weights = [1 / (i + 1) for i in range(60)] + [5, 1, 1]
    rows = [(7 * i, " ".join(rng.choices(words, weights, k=rng.randrange(40)))) for i in range(n)]
    got = {r["doc_id"]: r for r in imatch.compare_edited(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = [t for _, t in rows]
    edits = []
    for i, t in enumerate(texts):
        j, k = (i + 1) % n, len(t) // 2
        edits.append((i, j, t[: len(t) - k] + texts[j][:k]))
    prints, edited = slow(texts, edits)
    for i, (d, _) in enumerate(rows):
        r = got[d]
        assert (r["fingerprint"], r["edited_fingerprint"], r["edited_sha256"]) == (prints[i], edited[i], sha(edits[i][2]))
        assert math.isclose(r["near_edited"], alike(prints[i], edited[i])) and math.isclose(r["near_next"], alike(prints[i], prints[(i + 1) % n]))


def test_null_and_repeated_ids_are_rows(spark):
    rows = [(None, f"some words number {i} and pair{i // 2}") for i in range(50)] + [(5, "a b"), (5, "a b"), (5, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = imatch.compare_edited(df).collect()
    assert Counter(r["doc_id"] for r in got) == {-1: 50, 5: 3}
    assert sorted(r["n_chars"] for r in got) == sorted(len(t or "") for _, t in rows)
    assert Counter((r["doc_id"], r["text"]) for r in imatch.fingerprints(df).collect()) == Counter((d or -1, t or "") for d, t in rows)


def test_main_path_is_native(spark, sf):
    plan = imatch.op8(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
