"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the documents' windows.

Benchmark items become windows of N words (an item of fewer words is one window). The windows are broadcast in
blocks of at most MAX_BROADCAST bytes, counted before they are sent, and at most MAX_BLOCKS of them are out at a time: a
larger benchmark takes several passes over the documents, each of which writes only its hits and then takes its blocks
back, so neither the driver nor a worker ever holds more and no size is refused. Each window is filed under its longest word, its anchor. A
document is scanned by looking its words up among the anchors; around each anchor found, the window is looked
up in the hash set and so verified in full. Documents stay where they are: there is no shuffle of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import documents, read, stored

MAX_BROADCAST, MAX_BLOCKS = 32 << 20, 4
#: A-Z to a-z; every byte that isn't a digit, a letter or beyond ASCII to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPANS = "array<struct<start:int,stop:int>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows(ws: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []


class Windows:
    """The hash set: window to item numbers, and the windows' lengths and offsets by anchor."""

    def __init__(self, items: dict[bytes, list[str]]):
        self.items = items
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        found: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
        for gram in items:
            ws = gram.split(b" ")
            at = max(range(len(ws)), key=lambda i: (len(ws[i]), ws[i]))
            found[ws[at]].add((at, len(ws)))
        self.anchors = {k: sorted(v) for k, v in found.items()}
        self.keys = frozenset(self.anchors)

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (start, stop) word spans that are hit, and the items with windows found."""
        if self.keys.isdisjoint(ws):
            return [], set()
        hits, items = [], set()
        for i, w in enumerate(ws):
            if w in self.keys:
                for at, n in self.anchors[w]:
                    if i >= at and i - at + n <= len(ws) and (of := self.items.get(b" ".join(ws[i - at : i - at + n]))):
                        hits.append((i - at, i - at + n))
                        items.update(of)
        return merge(hits), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(rows: Iterator, n: int, limit: int) -> Iterator[dict[bytes, list[str]]]:
    """Item rows (item_id, text) to window tables of at most about limit bytes each."""
    table: dict[bytes, list[str]] = {}
    size = 0
    for item, text in rows:
        for gram in windows(words(text), n):
            if item not in (own := table.setdefault(gram, [])):
                own.append(item)
                size += len(gram) + len(item) + 200
            if size >= limit:
                yield table
                table, size = {}, 0
    if table:
        yield table


def _scan(sent):
    @F.pandas_udf(f"n_words long, spans {_SPANS}, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams = Windows(sent.value)
        for texts in batches:
            rows = []
            for text in texts:
                ws = words(text)
                hit, of = grams.scan(ws)
                rows.append((len(ws), [{"start": a, "stop": b} for a, b in hit], sorted(of)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan.asNondeterministic()  # so it isn't run once for each column that is read


def _merge(parts: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "stop": b} for a, b in merge([(s["start"], s["stop"]) for s in p])] for p in parts])


def remove_spans(text: str | None, spans: list) -> str | None:
    """The text without the bytes from the first to the last character of each span of words."""
    if not text or not len(spans):
        return text
    raw = text.encode()
    starts = (b" " + raw).translate(_FOLD)
    places, inside, at = [], False, 0
    for at, c in enumerate(starts[1:]):
        if (c != 32) != inside:
            inside = not inside
            places.append(at)
    if inside:
        places.append(at + 1)
    out, last = [], 0
    for s in spans:
        out.append(raw[last : places[2 * s["start"]]])
        last = places[2 * s["stop"] - 1]
    return (b"".join(out) + raw[last:]).decode()


def _remove(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([remove_spans(t, s) for t, s in zip(texts, spans, strict=True)])


def _scanned(found: DataFrame, some: list[dict[bytes, list[str]]]) -> tuple[DataFrame, list]:
    """Adds n_words, spans and items by these blocks; also their broadcasts."""
    scans, kept = [found.sparkSession.sparkContext.broadcast(b) for b in some or [{}]], found.columns
    for i, sent in enumerate(scans):
        found = found.withColumn(f"scan{i}", _scan(sent)("text"))
    parts = [F.col(f"scan{i}") for i in range(len(scans))]
    spans, items = (F.concat(*[p[c] for p in parts]) for c in ("spans", "items"))
    found = found.select(*kept, parts[0]["n_words"].alias("n_words"), spans.alias("spans"), F.array_distinct(items).alias("items"))
    if len(scans) > 1:
        found = found.withColumn("spans", F.pandas_udf(_merge, _SPANS)("spans"))
    return found, scans


def _in_passes(found: DataFrame, some: list[dict[bytes, list[str]]], rest: Iterator[dict[bytes, list[str]]]) -> DataFrame:
    """The same by several passes: hits of each are written by id and hash of the text, and joined in the end."""
    key, passes = [F.col("doc_id").alias("hit_id"), F.xxhash64("text").alias("hit_text")], []
    while some:
        scanned, scans = _scanned(found, some)
        passes.append(stored(scanned.where(F.size("spans") > 0).select(*key, "spans", "items"), "hits"))
        for sent in scans:
            sent.destroy()
        some = list(islice(rest, MAX_BLOCKS))
    hits = reduce(DataFrame.unionByName, passes).dropDuplicates(["hit_id", "hit_text", "spans", "items"])
    hits = hits.groupBy("hit_id", "hit_text").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    hits = hits.withColumn("spans", F.pandas_udf(_merge, _SPANS)("spans"))
    kept, n = found.columns, F.pandas_udf(lambda texts: pd.Series([len(words(t)) for t in texts]), "long")
    both = found.join(hits, (F.col("doc_id") == F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_text")), "left")
    spans, items = F.coalesce("spans", F.array().cast(_SPANS)), F.coalesce("items", F.array().cast("array<string>"))
    return both.select(*kept, n("text").alias("n_words"), spans.alias("spans"), items.alias("items"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, limit: int = MAX_BROADCAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, spans (merged word spans), items (item ids as strings), n_hit, contaminated,
    and carried; a row for each row of docs.

    A document is contaminated if it has a hit and at least this share of its words is hit. Null and empty
    texts have no words and no hits, very long ones are scanned whole; items without words are ignored; a null item_id
    is the item "null", a null doc_id is -1. Rows of either table that repeat are independent. Columns that aren't in carry
    are ignored, whatever their names. Without documents there are no rows, without items no hits.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string"))
    made = blocks(rows.toLocalIterator(), n, limit)
    some, found = list(islice(made, MAX_BLOCKS)), documents(docs, carry)
    more = next(made, None)
    found = _scanned(found, some)[0] if more is None else _in_passes(found, some, chain([more], made))
    found = found.withColumn("items", F.array_sort("items")).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words") - 1e-9))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 13, share: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, carried without contaminated documents (mode document) or hit spans (mode span)."""
    found = contaminated_spans(docs, benchmark, n, share, carry=carry)
    if mode == "document":
        found = found.where("not contaminated")
    elif mode == "span":
        found = found.withColumn("text", F.pandas_udf(_remove, "string")("text", "spans"))
    else:
        raise ValueError(mode)
    return found.select("doc_id", "text", *(["carried"] if carry else []))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
