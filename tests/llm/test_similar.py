from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline as pipeline
from segspark.llm import similar
from segspark.llm.common import read
from segspark.llm.simhash import fingerprint
from tests.llm.test_simhash import roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_shingles(text: str | None, width: int = 5) -> frozenset:
    ws = (text or "").encode().lower().split()
    return frozenset(b" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))) if ws else frozenset()


def brute(texts: dict[int, str | None], similarity: float = 0.8) -> dict[int, int]:
    s = {d: slow_shingles(t) for d, t in texts.items()}
    pairs = [(a, b) for a, b in combinations(s, 2) if s[a] == s[b] or (s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= similarity)]
    return roots(pairs, s)


def test_shingles():
    for t in (None, "", " \t", "One", "a b c d", "a b c d e", "A b c d e f a b c d e f é"):
        assert len(similar.shingles(t)) == len(slow_shingles(t))
    assert list(similar.shingles("A b\tC d  e f")) == list(similar.shingles("a b c d e f"))


def test_stage_keeps_one_of_each_group_of_five_word_copies(spark, sf, tmp_path):
    """The stage's real input: pairs at 0.8 or more go whatever their fingerprints."""
    docs = read(spark, sf, "documents")
    for name, stage in pipeline.STAGES[:2]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    got = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == {d for d, c in want.items() if d == c}


def test_groups_against_brute_force(spark, monkeypatch):
    """Copies around 0.8, chains, a large group around one text, equal texts, empty ones, repeated and missing ids."""
    monkeypatch.setattr(similar, "ENTRIES", 8)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, base = [], [[word() for _ in range(rng.choice((6, 30, 150)))] for _ in range(30)]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(4):
            b = list(b)
            for _ in range(max(1, len(b) // 60)):
                b[rng.randrange(len(b))] = word()
            texts.append(" ".join(b))
    hub = [word() for _ in range(200)]
    texts += [" ".join([*hub[:i], word(), *hub[i + 1 :]]) for i in range(0, 200, 4)]
    loose = [word() for _ in range(120)]
    texts += [" ".join(word() if rng.random() < 0.02 else w for w in loose) for _ in range(60)]
    texts += [*texts[:5], None, "", " \t", "one", "One ", "one two"]
    rng.shuffle(texts)
    want = brute(dict(enumerate(texts)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in similar.similar_documents(df).collect()} == want
    odd = spark.createDataFrame([(3, "a b c", "", "", 0), (None, "A b c", "", "", 0), (3, "x y", "", "", 0), (3, "x y", "", "", 0)], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"]) for r in similar.similar_documents(odd).collect()) == [(-1, -1), (3, -1), (3, 3), (3, 3)]
    assert similar.similar_documents(df.where("false")).count() == 0


def test_stage_proposes_by_simhash(spark, monkeypatch):
    """Through the stage, fingerprints go through the vantage-point shards, and all within 3 bits are joined by proposals."""
    rng, seen = random.Random(8), {}
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [[word() for _ in range(400)] for _ in range(8)]
    texts = [" ".join([*b[:i], word(), *b[i + 1 :]]) for b in base for i in (50, 150, 250, 350)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    ask = similar.fingerprint_pairs
    monkeypatch.setattr(similar, "fingerprint_pairs", lambda c, s: seen.setdefault("pairs", ask(c, s)))
    assert {r["doc_id"] for r in pipeline.near_dedup(spark, df, "").collect()} == {i for i in range(32) if i % 4 == 0}
    key = [similar.set_key(similar.shingles(t)) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fingerprint(texts[a], 5) ^ fingerprint(texts[b], 5)).bit_count() <= 3]
    assert near
    named = {k: i for i, k in enumerate(key)}
    joined = roots([(named[r["u"]], named[r["v"]]) for r in seen["pairs"].collect()], range(len(texts)))
    assert joined == roots(near, range(len(texts)))
