from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from segspark.llm import quality

SCHEMA = "doc_id long, text string"


def test_label_model_finds_the_accuracies():
    """Votes drawn from known rates: the rates and the hidden labels come back."""
    rng = np.random.default_rng(1)
    n, m = 20_000, len(quality.NAMES)
    y = rng.random(n) < 0.7
    right = np.linspace(0.65, 0.95, m)
    v = np.where(rng.random((n, m)) < right, y[:, None], ~y[:, None]).astype(int)
    v[rng.random((n, m)) < 0.3] = 2
    patterns: dict[str, int] = {}
    for row in v:
        k = "".join("01-"[x] for x in row)
        patterns[k] = patterns.get(k, 0) + 1
    share, rates = quality.label_model(patterns)
    assert abs(share - 0.7) < 0.03
    for i in range(m):
        assert abs(rates[i, 1, 1] / (rates[i, 1, 0] + rates[i, 1, 1]) - right[i]) < 0.04
    assert ((quality.posterior(v, share, rates) > 0.5) == y).mean() > 0.95


def test_cases(spark):
    good = "This is a plain text, as it should be. It goes on for a while and has some words in it. "
    rows = [(1, good * 3), (2, "| a | b |\n| c | d |" * 20), (3, None), (4, ""), (5, "word " * 300), (None, good), (1, good * 3), (7, "x" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("votes", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.classify(df).collect()}
    assert quality.classify(df).count() == len(rows)
    assert got[1]["posterior"] > 0.5 > got[2]["posterior"] and got[3]["votes"] == got[4]["votes"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.classify(df.where("false")).count() == 0


def slow(texts: list[str | None], dimensions: int) -> list[tuple[str, float, float]]:
    """The whole operator again, a document, a labeller and a weight at a time; every text is in the sample."""

    def facts(t):
        t = t or ""
        ws, rows = t.split(), [r for r in t.split("\n") if r.strip()]
        n, c = max(1, len(ws)), max(1, len(t))
        ends = [i for i, x in enumerate(t) if x in ".!?" and (i + 1 == len(t) or t[i + 1].isspace())]
        return {
            "words": len(ws), "chars": len(t), "distinct": len(set(ws)) / n, "repeats": sum(ws[i] == ws[i - 1] for i in range(1, len(ws))) / n,
            "symbols": sum(not any(x.isalnum() for x in w) for w in ws) / n, "marks": sum(x in "|#{}<>*$%&=\\~^_" for x in t) / c,
            "sentences": len(ends) / n, "digits": sum(x.isdigit() for w in ws for x in w) / c, "length": sum(len(w) for w in ws) / n,
            "short": sum(len(w) <= 4 for w in ws) / n, "lines": 1 - len(set(rows)) / max(1, len(rows)),
        }

    def vote(s):
        if not s["words"]:
            return "".join("0" if k == "size" else "-" for k in quality.NAMES)
        return "".join("0" if s[of] < below or s[of] > above else "1" if lo <= s[of] <= hi else "-" for of, lo, hi, below, above in quality.LABELLERS.values())

    facts_of = [facts(t) for t in texts]
    patterns = [vote(s) for s in facts_of]
    post = [1 / (1 + math.exp(-(p.count("1") - 1.5 * p.count("0")))) for p in patterns]
    m = len(quality.NAMES)
    for _ in range(100):
        share = min(0.99, max(0.01, sum(post) / len(post)))
        rates = []
        for i in range(m):
            own = [[1 + sum((q if c else 1 - q) for p, q in zip(patterns, post, strict=True) if p[i] == v) for v in "01-"] for c in (0, 1)]
            rates.append([[x / sum(row) for x in row] for row in own])
        for r in rates:
            for v in (0, 1):
                if r[1 - v][v] > r[v][v]:
                    r[0][v] = r[1][v] = (r[0][v] + r[1][v]) / 2

        def odds(p, share=share, rates=rates):
            a, b = (math.log(x) + sum(math.log(rates[i][c]["01-".index(p[i])]) for i in range(m)) for c, x in ((0, 1 - share), (1, share)))
            return 1 / (1 + math.exp(a - b))

        post = [odds(p) for p in patterns]

    def features(t, s):
        out = []
        counts = Counter((t or "").lower().split())
        size = max(1.0, math.sqrt(sum(counts.values())))
        marks = [f"\0{k}{round(4 * math.log2(x + 1e-3))}" for k, x in s.items() if k not in ("words", "chars")]
        out += [(zlib.crc32(w.encode()) % dimensions, math.sqrt(n) / size) for w, n in counts.items()]
        return out + [(zlib.crc32(x.encode()) % dimensions, 1 / math.sqrt(len(marks))) for x in marks]

    data = [features(t, s) for t, s in zip(texts, facts_of, strict=True)]
    w, seen, bias, seen_bias = defaultdict(float), defaultdict(lambda: 1e-2), 0.0, 1e-2
    order = np.random.default_rng(7)
    for _ in range(6):
        for i in order.permutation(len(data)):
            g = 1 / (1 + math.exp(-(sum(w[k] * x for k, x in data[i]) + bias))) - post[i]
            steps = {k: g * x + 1e-5 * w[k] for k, x in data[i]}
            for k, step in steps.items():
                seen[k] += step * step
            for k, step in steps.items():
                w[k] -= 0.5 * step / math.sqrt(seen[k])
            seen_bias += g * g
            bias -= 0.5 * g / math.sqrt(seen_bias)
    return [(p, q, 1 / (1 + math.exp(-(sum(w[k] * x for k, x in f) + bias)))) for p, q, f in zip(patterns, post, data, strict=True)]


def test_against_brute_force(spark):
    rng = random.Random(4)
    plain = "the and of it was a plain word text goes on for some while here".split()
    texts: list[str | None] = [None, "", "one", "#### | $$ |", "word " * 40]
    for i in range(45):
        ws = rng.choices(plain, k=rng.randrange(3, 40))
        texts.append(" ".join(w + rng.choice(("", "", ".", "!", " |", " 12")) if i % 3 else w + ". " * (j % 7 == 6) for j, w in enumerate(ws)) + rng.choice(("", "\nline\nline\nline")))
    got = {r["doc_id"]: r for r in quality.classify(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for i, (pattern, post, score) in enumerate(slow(texts, quality.DIMENSIONS)):
        assert got[i]["votes"] == pattern and math.isclose(got[i]["posterior"], post, rel_tol=1e-6, abs_tol=1e-12)
        assert math.isclose(got[i]["score"], score, rel_tol=1e-6), i


def test_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    seen, real = [], quality.train
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(len(rows)) or real(rows))
    df = spark.createDataFrame([(None, f"text number {i} of some words.") for i in range(400)] + [(1, "same")] * 400, SCHEMA)
    assert quality.classify(df, train_docs=100).count() == 800
    assert quality.classify(df, train_docs=1000, train_chars=300).count() == 800
    assert 20 < seen[0] < 120 and 5 < seen[1] < 15


def test_scores_agree_with_true_labels(spark):
    """No label enters the fit, but the labellers were written after reading some labelled documents of the same
    generator: a check that the parts work together, not a blind estimate of quality."""
    sf = "/root/testdata/sf0.01"
    rows = quality.op7(spark, sf).drop("quality").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "posterior", "quality").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.9
