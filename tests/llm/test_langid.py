from __future__ import annotations

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from segspark.llm import langid

PIECES = [bytes([b]) for b in range(256)] + [b" th", b"the", b"he", b" t", b"ab", b"aba"]


def brute(word: bytes, probs: dict[bytes, float]) -> float:
    """The sum over all segmentations, one after another."""
    if not word:
        return 1.0
    return sum(probs[word[:k]] * brute(word[k:], probs) for k in range(1, len(word) + 1) if word[:k] in probs)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    p = rng.random((len(PIECES), 2))
    p /= p.sum(axis=0)
    s = langid.Scorer(PIECES, p)
    words = ["the", "ababa", "é", "thethe", "x"]
    got = s.score([[w] for w in words])
    for w, row in zip(words, got, strict=True):
        for g in range(2):
            want = math.log(brute(b" " + w.encode(), {x: p[i, g] for i, x in enumerate(PIECES)}))
            assert math.isclose(row[g], want, rel_tol=1e-9)
            assert math.isclose(s.long_word(b" " + w.encode())[g], want, rel_tol=1e-9)
    assert np.allclose(s.score([words])[0], got.sum(axis=0))
    assert np.isfinite(s.score([["ab" * 50_000]])).all()


def test_fitting_raises_the_likelihood():
    counts = {"a": Counter({"the": 5, "thethe": 2}), "b": Counter({"ababa": 4, "x": 1})}
    last = -math.inf
    for rounds in (1, 2, 4):
        langs, p = langid.fit(counts, PIECES, rounds)
        s = langid.Scorer(PIECES, p)
        now = sum(n * s.score([[w]])[0][i] for i, g in enumerate(langs) for w, n in counts[g].items())
        assert now > last - 1e-6
        last = now
    assert np.allclose(p.sum(axis=0), 1)


def test_cases(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(8)] + [(i, "der hund und die katze", "de") for i in range(8, 16)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "en"), (103, "die hunde", None), (None, "the dogs", None), (103, "die hunde", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = [(r["doc_id"], r["lang_pred"], r["held_out"]) for r in langid.identify(df).collect()]
    by = {d: p for d, p, _ in got}
    assert [by[i] for i in (100, 101, 102)] == ["und"] * 3 and by[103] == "de" and by[-1] == "en" and len(got) == len(rows)
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, h in got)
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(bare).collect()} == {"und"}
    assert langid.identify(df.where("false")).count() == 0


def test_languages_without_spaces(spark):
    """Clauses of more bytes than are fitted at once still teach their language."""
    rng = random.Random(3)
    kinds = {"x": [chr(0x4E00 + i) for i in range(60)], "y": [chr(0x4E00 + i) for i in range(40, 100)], "z": [chr(0x3042 + i) for i in range(60)]}
    rows = [(i, "\n".join("".join(rng.choices(kinds[g], k=rng.randrange(20, 60))) for _ in range(4)), g) for i in range(240) for g in [rng.choice("xyz")]]
    rows += [(1000 + i, "some short words in between", "en") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {d: g for d, _, g in rows}
    got = langid.identify(df).where("held_out").collect()
    assert len(got) > 50 and sum(r["lang_pred"] == want[r["doc_id"]] for r in got) > 0.97 * len(got)


def test_long_words_are_cut_between_characters():
    for w in ("a" * 100, "日本" * 40, "é" * 39, "short", "x" * 39, "x" * 40):
        cut = langid.parts(w)
        assert b"".join(cut) == b" " + w.encode() and all(len(p) <= langid.MAX_BULK and p.decode() for p in cut)
    langs, probs = langid.fit({"a": Counter({"ab" * 60: 3}), "b": Counter({"the" * 30: 2})}, PIECES)
    s = langid.Scorer(PIECES, probs)
    assert s.score([["ab" * 60]])[0].argmax() == 0 and s.score([["the" * 30]])[0].argmax() == 1


def slow_predictions(rows, pieces, rounds):
    """The whole operator again, one step after another: counts, forward-backward over each word, scores."""
    langs = sorted({g for d, t, g in rows if g and t and zlib.crc32(str(d).encode()) % 4 != 2})
    counts = {g: Counter() for g in langs}
    for d, t, g in rows:
        if g and t and zlib.crc32(str(d).encode()) % 4 != 2:
            counts[g].update(t.lower().split())
    probs = {g: dict.fromkeys(pieces, 1 / len(pieces)) for g in langs}

    def sums(w, p):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * p.get(w[i:j], 0) for i in range(j))
        return a

    for _ in range(rounds):
        for g in langs:
            own = dict.fromkeys(pieces, 0.0)
            for w, n in counts[g].items():
                w = b" " + w.encode()
                a, b = sums(w, probs[g]), sums(w[::-1], {k[::-1]: v for k, v in probs[g].items()})[::-1]
                for i in range(len(w)):
                    for j in range(i + 1, len(w) + 1):
                        if w[i:j] in own:
                            own[w[i:j]] += n * a[i] * probs[g][w[i:j]] * b[j] / a[-1]
            total = sum(own.values())
            probs[g] = {k: (v / total + langid.FLOOR) / (1 + langid.FLOOR * len(pieces)) for k, v in own.items()}
    out = {}
    for d, t, _ in rows:
        if not t or not any(map(str.isalpha, t)):
            out[d] = ("und", 0.0)
            continue
        log = [sum(math.log(sums(b" " + w.encode(), probs[g])[-1]) for w in t.lower().split()) for g in langs]
        p = [math.exp(x - max(log)) for x in log]
        best = max(range(len(langs)), key=lambda i: (p[i], -i))
        out[d] = (langs[best], p[best] / sum(p))
    return out


def test_whole_operator_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = {"en": ["the", "then", "cat", "ab", "he"], "de": ["der", "aba", "katze", "hat", "ab"]}
    rows = [(i, " ".join(rng.choices(words[g], k=rng.randrange(1, 6))), g if i % 5 else None) for i in range(60) for g in [rng.choice(["en", "de"])]]
    rows += [(100, None, "en"), (101, "12 !", None), (102, "The CAT", None)]
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(PIECES)))
    want = slow_predictions(rows, PIECES, 3)
    for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(path)).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and math.isclose(r["score"], want[r["doc_id"]][1], rel_tol=1e-6, abs_tol=1e-9), r


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op5(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").select("doc_id", "lang"), "doc_id")
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 or score > 1").count() == 0
