"""Quality classifier from weak labels.

LABELLERS look at a whole text and vote good (1), bad (0) or not at all (-1). Expectation-maximisation fits how
often each votes, and how, on good and on bad texts, from the counts of vote patterns over all documents (at
most 3 ** len(LABELLERS) patterns, however many documents). The posterior of each pattern then labels a
bounded sample of documents, TRAIN_DOCS in expectation, chosen by a hash of id and text and no more than TRAIN_CHARS code
points of text in all, on which a linear scorer over hashed words and shapes is fitted by logistic regression. Texts are read
twice in full, once for the patterns' counts and once for the scores. All documents are scored over their whole texts. No true label enters the
fit; but the labellers and their thresholds were written after reading some 25 labelled documents of the synthetic
tables (tables of bars, repeated words), so how well scores agree with labels there is not a blind measure.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents, read

TRAIN_DOCS, TRAIN_CHARS, DIMENSIONS, MAX_WORDS = 4000, 1 << 28, 1 << 16, 300_000
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


def statistics(text: str | None) -> dict[str, float]:
    """Ratios over the whole text that the labellers read."""
    t = text or ""
    ws = t.split()
    n = max(1, len(ws))
    counts = Counter(ws)
    rows = [r for r in t.split("\n") if r.strip()]
    return {
        "words": len(ws),
        "chars": len(t),
        "distinct": len(counts) / n,
        "repeats": sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n,
        "symbols": sum(v for w, v in counts.items() if not any(map(str.isalnum, w))) / n,
        "marks": sum(t.count(c) for c in "|#{}<>*$%&=\\~^_") / max(1, len(t)),
        "sentences": len(_SENTENCE.findall(t)) / n,
        "digits": sum(v * sum(map(str.isdigit, w)) for w, v in counts.items()) / max(1, len(t)),
        "length": sum(map(len, ws)) / n,
        "short": sum(v for w, v in counts.items() if len(w) <= 4) / n,
        "lines": 1 - len(set(rows)) / max(1, len(rows)),
    }


# Thresholds: (statistic, good from, good to, bad below, bad above); between good and bad there is no vote.
LABELLERS = {
    "symbols": ("symbols", 0.0, 0.02, -1.0, 0.1),
    "marks": ("marks", 0.0, 0.005, -1.0, 0.02),
    "repeats": ("repeats", 0.0, 0.05, -1.0, 0.15),
    "sentences": ("sentences", 0.02, 0.25, 0.008, 0.5),
    "short words": ("short", 0.25, 0.75, 0.15, 0.95),
    "word length": ("length", 3.0, 9.0, 2.0, 14.0),
    "distinct": ("distinct", 0.3, 1.0, 0.12, 2.0),
    "size": ("words", 8, float("inf"), 3, float("inf")),
    "lines": ("lines", 0.0, 0.1, -1.0, 0.35),
}
NAMES = tuple(LABELLERS)


def votes(s: dict[str, float]) -> str:
    """One character for each labeller: 1, 0 or - for no vote."""
    if not s["words"]:
        return "-" * (len(NAMES) - 2) + "0-"
    out = []
    for of, lo, hi, below, above in LABELLERS.values():
        x = s[of]
        out.append("0" if x < below or x > above else "1" if lo <= x <= hi else "-")
    return "".join(out)


def label_model(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray]:
    """The share of good texts, and rates[labeller, class, vote] with votes 0, 1 and none."""
    keys = sorted(patterns)
    v = cast(keys)
    weight = np.array([patterns[k] for k in keys], float)
    good = (v == 1).sum(axis=1) - 1.5 * (v == 0).sum(axis=1)
    post = 1 / (1 + np.exp(-good))
    share, rates = 0.5, np.full((len(NAMES), 2, 3), 1 / 3)
    for _ in range(rounds):
        by_class = np.stack([(1 - post) * weight, post * weight])
        share = float(np.clip(by_class[1].sum() / max(1e-9, weight.sum()), 0.01, 0.99))
        for i in range(len(NAMES)):
            own = np.stack([np.bincount(v[:, i], w, 3) for w in by_class]) + 1.0
            rates[i] = own / own.sum(axis=1, keepdims=True)
        # A labeller is never taken for worse than chance, so the classes can't change places.
        for vote in (0, 1):
            wrong = rates[:, 1 - vote, vote] > rates[:, vote, vote]
            rates[wrong, :, vote] = rates[wrong, :, vote].mean(axis=1, keepdims=True)
        post = posterior(v, share, rates)
    return share, rates


def cast(patterns: list[str]) -> np.ndarray:
    """Patterns as rows of votes: 0, 1, or 2 for none."""
    return np.array([["01-".index(c) for c in x] for x in patterns], np.int64).reshape(len(patterns), len(NAMES))


def posterior(v: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    log = np.log([1 - share, share])[None, :] + sum(np.log(rates[i][:, v[:, i]]).T for i in range(len(NAMES)))
    log -= log.max(axis=1, keepdims=True)
    p = np.exp(log)
    return p[:, 1] / p.sum(axis=1)


def _votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"votes": [votes(statistics(t)) for t in f["text"]]})


def shapes(s: dict[str, float]) -> list[str]:
    """The statistics in eighths of powers, as feature names."""
    return [f"\0{k}{int(np.round(4 * np.log2(x + 1e-3)))}" for k, x in s.items() if k not in ("words", "chars")]


class Features:
    """Hashed features of a text: dimension and weight; words by square root of their count, to length 1."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.places = dimensions, {}

    def _place(self, w: str) -> int:
        p = self.places.get(w)
        if p is None:
            if len(self.places) >= MAX_WORDS:
                self.places.clear()
            p = self.places[w] = zlib.crc32(w.encode()) % self.dimensions
        return p

    def of(self, text: str | None, s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Of a text and its statistics."""
        counts = Counter((text or "").lower().split())
        marks = shapes(s)
        at = np.fromiter(map(self._place, [*counts, *marks]), np.int64, len(counts) + len(marks))
        x = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
        x = np.concatenate([x / max(1.0, float(np.sqrt((x * x).sum()))), np.full(len(marks), 1 / np.sqrt(max(1, len(marks))))])
        return at, x


def train(rows: list[tuple[str | None, float]], dimensions: int = DIMENSIONS, rounds: int = 6, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights, the last one the bias: logistic regression on soft labels, steps scaled by past gradients."""
    features = Features(dimensions)
    data = [(*features.of(t, statistics(t)), y) for t, y in rows]
    w, seen = np.zeros(dimensions + 1), np.full(dimensions + 1, 1e-2)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(data)):
            at, x, y = data[i]
            g = 1 / (1 + np.exp(-(w[at] @ x + w[-1]))) - y
            step = g * x + decay * w[at]
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
            seen[-1] += g * g
            w[-1] -= rate * g / np.sqrt(seen[-1])
    return w


def _score(sent):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, share, rates = sent.value
        features, known = Features(len(w) - 1), {}
        for f in frames:
            pattern, post, score = [], [], []
            for t in f["text"]:
                s = statistics(t)
                v, (at, x) = votes(s), features.of(t, s)
                if v not in known:  # at most one for each pattern
                    known[v] = float(posterior(cast([v]), share, rates)[0])
                pattern.append(v)
                post.append(known[v])
                score.append(float(1 / (1 + np.exp(-(w[at] @ x + w[-1])))))
            yield pd.DataFrame({"doc_id": f["doc_id"], "votes": pattern, "posterior": post, "score": score})

    return run


def classify(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, votes, posterior (of good, by the label model), score (of good, by the scorer) for each row.

    Null and empty texts get a vote for bad from the labeller of sizes and none from others. Repeated rows are rows of their
    own with equal results, and count once in the sample; a null id is -1. A score of 0.5 is neither good nor bad here; the
    query calls it good. Very long texts are read whole. Other columns are ignored, whatever their names. No rows give none.
    """
    spark = docs.sparkSession
    d = documents(docs)
    voted = d.mapInPandas(_votes, "votes string")
    patterns = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    share, rates = label_model(patterns) if patterns else (0.5, np.full((len(NAMES), 2, 3), 1 / 3))
    total = max(1, sum(patterns.values()))
    # By a hash of id and text, repeated rows once: many rows with one id don't come or stay together.
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30))
    some = d.withColumn("place", place).where(F.col("place") < F.lit(int(min(1.0, train_docs / total) * (1 << 30)))).dropDuplicates(["doc_id", "text"])
    rows, chars = [], 0
    for r in some.orderBy("place", "doc_id", "text").toLocalIterator():
        chars += len(r["text"] or "")
        if rows and chars > train_chars:
            break
        rows.append((r["doc_id"], r["text"]))
    # In order of ids, so the weights don't depend on how rows arrive.
    rows = sorted(rows, key=lambda x: (x[0], x[1] or ""))
    y = posterior(cast([votes(statistics(t)) for _, t in rows]), share, rates) if rows else []
    w = train([(t, float(p)) for (_, t), p in zip(rows, y, strict=True)])
    return d.mapInPandas(_score(spark.sparkContext.broadcast((w, share, rates))), "doc_id long, votes string, posterior double, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents")).select("doc_id", "votes", "posterior", "score", (F.col("score") >= 0.5).cast("int").alias("quality"))
