"""Language ID with segmentation-marginalised unigrams over a fixed public vocabulary.

A language gives each piece of the vocabulary (byte strings of a public byte-level BPE file) a probability. The
probability of a word is the sum over all its segmentations into pieces of their products, by the forward
algorithm; a text's is the product over its words (lower-cased, a space before each). Piece probabilities are
fitted by expectation-maximisation over all segmentations (forward-backward) of the words of a bounded sample
of labelled texts: SAMPLE_DOCS texts a language in expectation, chosen by a hash of id and text, and of these the
SAMPLE_WORDS commonest words. In languages written without spaces a word between white space is a clause: words above
MAX_BULK bytes are fitted in parts of at most that many bytes, cut between characters, and all parts count. Every text is
scored over all its words, long ones whole. The sum over segmentations depends on the word alone, so each task keeps the
scores of words it has seen, at most MAX_WORDS of them.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm.common import documents, read

SAMPLE_DOCS, SAMPLE_WORDS = 400, 20_000
ROUNDS = 3
#: The longest word (with the space before it) fitted and scored in bulk, and the words kept.
MAX_BULK, MAX_WORDS = 40, 200_000
FLOOR = 1e-6
#: Rolling hashes of byte strings: h(s + b) = h(s) * BASE + b + 1, modulo 2**64; a table of 2**MASK_BITS marks what may be a piece.
BASE, MASK_BITS = np.uint64(0x9E3779B97F4A7C15), 20


def load_pieces(path: str) -> list[bytes]:
    """Pieces by rank of a tiktoken file; all 256 bytes are among them, so any text can be cut."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_of(text: str) -> list[str]:
    return text.lower().split()


def parts(word: str) -> list[bytes]:
    """The word with a space before it, in parts of at most MAX_BULK bytes cut between characters."""
    raw, out, at = b" " + word.encode(), [], 0
    while len(raw) - at > MAX_BULK:
        stop = at + MAX_BULK
        while raw[stop] & 0xC0 == 0x80:
            stop -= 1
        out.append(raw[at:stop])
        at = stop
    return [*out, raw[at:]]


class Scorer:
    """Log probabilities of words under each language; probs has a row for each piece."""

    def __init__(self, pieces: list[bytes], probs: np.ndarray):
        self.probs = np.vstack([probs, np.zeros((1, probs.shape[1]))])
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.none = len(pieces)
        self.longest = max(map(len, pieces))
        self.sizes = sorted({len(p) for p in pieces})
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(MAX_BULK, BASE)]), dtype=np.uint64)
        short = [(self._hashes([p], len(p))[-1, 0], i) for i, p in enumerate(pieces) if len(p) <= MAX_BULK]
        own = np.array([h for h, _ in short], np.uint64)
        order = np.argsort(own)
        self.hashes, self.numbers = own[order], np.array([i for _, i in short], np.int32)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("pieces repeat, or two have one hash")
        self.mask = np.zeros(1 << MASK_BITS, bool)
        self.mask[self._slot(self.hashes)] = True
        self._start()

    def _start(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, self.probs.shape[1]))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(29))) * BASE >> np.uint64(64 - MASK_BITS)

    @staticmethod
    def _hashes(words: list[bytes], n: int) -> np.ndarray:
        """Of all prefixes of words of n bytes: a row for each length from 0."""
        b = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).T.astype(np.uint64) + np.uint64(1)
        h = np.zeros((n + 1, len(words)), np.uint64)
        for k in range(n):
            h[k + 1] = h[k] * BASE + b[k]
        return h

    def piece_ids(self, words: list[bytes], n: int) -> dict[tuple[int, int], np.ndarray]:
        """By (start, stop), by ascending stop, the piece numbers of words of n bytes, where any word has a piece."""
        prefix, out = self._hashes(words, n), {}
        for k in self.sizes:
            if k > n:
                break
            h = prefix[k:] - prefix[: n + 1 - k] * self.powers[k]
            at = np.flatnonzero(self.mask[self._slot(h)])
            found = h.ravel()[at]
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            ok = self.hashes[place] == found
            ids = np.full(h.size, self.none, np.int32)
            ids[at[ok]] = self.numbers[place[ok]]
            ids = ids.reshape(h.shape)
            for i in np.unique(at[ok] // len(words)).tolist():
                out[i, i + k] = ids[i]
        return dict(sorted(out.items(), key=lambda x: (x[0][1], x[0][0])))

    def forward(self, at: dict[tuple[int, int], np.ndarray], n: int, size: int) -> np.ndarray:
        alpha = np.zeros((n + 1, size, self.probs.shape[1]))
        alpha[0] = 1
        for (i, j), ids in at.items():
            alpha[j] += alpha[i] * self.probs[ids]
        return alpha

    def long_word(self, w: bytes) -> np.ndarray:
        """The same sum for one word of any length, in logarithms."""
        logs = [np.zeros(self.probs.shape[1])]
        for j in range(1, len(w) + 1):
            own = [(k, i) for k in self.sizes if k <= j and (i := self.ids.get(w[j - k : j])) is not None]
            before = np.array([logs[-k] for k, _ in own])
            top = before.max(axis=0)
            logs.append(top + np.log((np.exp(before - top) * self.probs[[i for _, i in own]]).sum(axis=0)))
            if len(logs) > 2 * self.longest:
                del logs[: -self.longest]
        return logs[-1]

    def _add(self, new: list[str]) -> None:
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in new:
            b = b" " + w.encode()
            by.setdefault(min(len(b), MAX_BULK + 1), []).append((w, b))
        while len(self.rows) + len(new) > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
        for n, group in by.items():
            for a in range(0, len(group), 8192):
                some = group[a : a + 8192]
                raw = [b for _, b in some]
                if n <= MAX_BULK:
                    own = np.log(np.maximum(self.forward(self.piece_ids(raw, n), n, len(raw))[n], 1e-300))
                else:
                    own = np.array([self.long_word(b) for b in raw])
                at = len(self.rows)
                self.scores[at : at + len(own)] = own
                self.rows.update((w, at + i) for i, (w, _) in enumerate(some))

    def score(self, texts: list[list[str]]) -> np.ndarray:
        """Log probability of each text (its words) under each language."""
        new = set().union(*texts).difference(self.rows) if texts else set()
        if len(self.rows) + len(new) > MAX_WORDS:
            self._start()
            new = set().union(*texts)
        self._add(sorted(new))
        get = self.rows.__getitem__
        out, sizes = np.zeros((len(texts), self.probs.shape[1])), np.array([len(ws) for ws in texts], np.int64)
        if sizes.any():
            at = np.fromiter(map(get, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
            out[sizes > 0] = np.add.reduceat(self.scores[at], (np.cumsum(sizes) - sizes)[sizes > 0], axis=0)
        return out


def fit(counts: dict[str, Counter], pieces: list[bytes], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (pieces x languages)."""
    langs = sorted(counts)
    total = np.zeros((len(pieces) + 1, len(langs)))
    probs = np.full((len(pieces), len(langs)), 1 / len(pieces))
    seen_in: dict[bytes, np.ndarray] = {}
    for i, g in enumerate(langs):
        for w, n in counts[g].items():
            for part in parts(w):
                seen_in.setdefault(part, np.zeros(len(langs)))[i] += n
    by: dict[int, list[bytes]] = {}
    for part in sorted(seen_in):
        by.setdefault(len(part), []).append(part)
    base = Scorer(pieces, probs)
    where = {n: base.piece_ids(ps, n) for n, ps in by.items()}
    seen = {n: np.array([seen_in[p] for p in ps]) for n, ps in by.items()}
    for _ in range(rounds):
        scorer = Scorer(pieces, probs)
        total[:] = 0
        for n, at in where.items():
            alpha = scorer.forward(at, n, len(seen[n]))
            beta = np.zeros_like(alpha)
            beta[n] = 1
            for (i, j), ids in sorted(at.items(), key=lambda x: (-x[0][1], -x[0][0])):
                beta[i] += beta[j] * scorer.probs[ids]
            weight = seen[n] / np.maximum(alpha[n], 1e-300)
            for (i, j), ids in at.items():
                np.add.at(total, ids, alpha[i] * scorer.probs[ids] * beta[j] * weight)
        own = total[:-1]
        probs = own / np.maximum(own.sum(axis=0), 1e-300)
        probs = (probs + FLOOR) / (1 + FLOOR * len(pieces))
    return langs, probs


def _sample(rows: DataFrame, docs_per_lang: int, words_per_lang: int) -> dict[str, Counter]:
    """Word counts by language of the sample; rows has doc_id, text, lang."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    # A hash of id and text below a language's share of all hashes; many rows with one id don't come or stay together.
    share = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    limit = F.create_map(*[F.lit(x) for g, n in sorted(sizes.items()) for x in (g, min(1.0, docs_per_lang / n))])
    some = rows.where(share < limit[F.col("lang")])
    words = some.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''")
    top = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # The commonest of each language are picked where they are; the driver gets no more than these.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, Counter] = {g: Counter() for g in sizes}
    for r in top.withColumn("rank", rank).where(F.col("rank") <= words_per_lang).toLocalIterator():
        out[r["lang"]][r["word"]] = r["n"]
    return out


def _predict(sent):
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, pieces, probs = sent.value
        scorer = Scorer(pieces, probs)
        for batch in batches:
            texts = batch.tolist()
            labels, scores = ["und"] * len(texts), np.zeros(len(texts))
            ok = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
            for a in range(0, len(ok), 256):
                some = ok[a : a + 256]
                s = scorer.score([words_of(texts[i]) for i in some])
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, best, row in zip(some, p.argmax(axis=1), p, strict=True):
                    labels[i], scores[i] = langs[best], row[best]
            yield pd.DataFrame({"lang_pred": labels, "score": scores})

    return predict.asNondeterministic()  # so it isn't run once for each column that is read


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, vocabulary: str | None = None, docs_per_lang: int = SAMPLE_DOCS, words_per_lang: int = SAMPLE_WORDS, rounds: int = ROUNDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score (posterior of the label with equal priors), and carried, for
    each row of docs.

    Labelled rows that aren't held out (crc32 of the id as text, mod 4, is 2) and have lang and text train the
    model. Texts that are null or have no letter are "und" with score 0, as are all where no row is labelled;
    ties go to the label that sorts first. A null id counts as -1; repeated rows are rows of their own, and no more than
    a text each to the sample's bound. Other columns are ignored, whatever their names. No rows give no rows.
    """
    own = documents(docs, ("lang",)).select("doc_id", "text", F.col("carried.lang").cast("string").alias("lang"))
    counts = _sample(own.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()), docs_per_lang, words_per_lang)
    pieces = load_pieces(vocabulary or default_vocabulary())
    langs, probs = fit(counts, pieces, rounds) if counts else ([], np.zeros((len(pieces), 1)))
    sent = docs.sparkSession.sparkContext.broadcast((langs, pieces, probs))
    found = documents(docs, carry).withColumn("p", _predict(sent)("text"))
    return found.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), "p.*", *(["carried"] if carry else []))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
