"""Sequence packing by non-negative least squares over the histogram of lengths.

Documents are cut into full windows and a rest. The histogram of the rests' lengths (at most one count for each
length, so bounded) goes to the driver. Combinations of up to three length bins that fill a window are the
columns, the binned histogram is the right side; the solved repeat counts are rounded down, bounded by the histogram, and
laid out with exact lengths of these bins that fill the window to the last id, so they leave no padding and cut nothing.
What finds no exact partner is packed greedily: the longest rest first, then the longest that fits, and where
nothing fits the shortest is cut to fill the window. Repeat counts stay counts all through, so the plan has
some thousand rows for any number of documents: "rests of length L with ranks a..b lie at these places of
sequences s..s+b-a". A rest's rank among its length's is a block's first rank plus its place in the
block; blocks are hashes of ids, so a length that a third of all documents have is dealt over all blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm.common import documents, read, stored
from segspark.llm.encode import default_path, encoder

WINDOW = 2048
BINS = 128
BLOCK_DOCS = 4096


def combinations(bins: int, unit: int = 1, depth: int = 3) -> list[tuple[int, ...]]:
    """Bin numbers from 1, largest first, whose lengths can fill bins * unit exactly; up to depth of them.

    Bin b holds the lengths above (b - 1) * unit up to b * unit, half a unit below its end on average, so m
    parts fill the window where their numbers add up to bins and half of m more.
    """

    def total(parts: int) -> int:
        return bins + round(parts * (unit - 1) / (2 * unit))

    out = [(bins,)]
    if depth > 1:
        out += [(total(2) - b, b) for b in range(1, total(2) // 2 + 1) if total(2) - b <= bins]
    if depth > 2:
        out += [(total(3) - b - c, b, c) for c in range(1, total(3) // 3 + 1) for b in range(c, (total(3) - c) // 2 + 1) if total(3) - b - c <= bins]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by an active set of columns."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    limit = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        if gain.max() <= limit:
            break
        active[int(gain.argmax())] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            # Go as far towards s as no weight turns negative, and let go of those that reach zero.
            bad = s <= 0
            step = float(np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)))
            x[at] += step * (s - x[at])
            gone = at[x[at] <= 1e-12]
            if not len(gone):
                gone = at[bad]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


class Pool:
    """Rests by length as runs (length, offset in the rest, first rank, last rank + 1)."""

    def __init__(self, counts: dict[int, int]):
        self.runs: dict[int, deque] = {n: deque([(n, 0, 0, c)]) for n, c in counts.items() if c > 0}

    def add(self, size: int, run: tuple[int, int, int, int]) -> None:
        self.runs.setdefault(size, deque()).append(run)

    def front(self, size: int) -> int:
        return self.runs[size][0][3] - self.runs[size][0][2]

    def take(self, size: int, n: int) -> tuple[int, int, int, int]:
        length, offset, lo, hi = self.runs[size].popleft()
        if lo + n < hi:
            self.runs[size].appendleft((length, offset, lo + n, hi))
        elif not self.runs[size]:
            del self.runs[size]
        return length, offset, lo, lo + n


def plan(counts: dict[int, int], window: int = WINDOW, bins: int = BINS) -> tuple[np.ndarray, int]:
    """Rows (length, offset in the rest, size, first rank, last rank + 1, first sequence, place), and the
    number of sequences. Every rank of every length is covered once over its whole length."""
    pool, rows, sequence = Pool(counts), [], 0
    unit = window // bins
    histogram = np.zeros(bins)
    for n, c in counts.items():
        histogram[-(-n // unit) - 1] += c

    def lay(sizes: list[int], times: int) -> None:
        nonlocal sequence
        place = 0
        for size in sizes:
            length, offset, lo, hi = pool.take(size, times)
            rows.append((length, offset, size, lo, hi, sequence, place))
            place += size
        sequence += times

    ways = combinations(bins, unit)
    a = np.zeros((bins, len(ways)))
    for j, way in enumerate(ways):
        for b in way:
            a[b - 1, j] += 1
    solved = np.floor(nnls(a, histogram) + 1e-6).astype(int) if histogram.any() else np.zeros(len(ways), int)

    def exact(way: tuple[int, ...], room: int, used: dict[int, int]) -> list[int] | None:
        """Lengths from the way's bins that add up to room; the last one may lie in a bin beside its own."""
        if len(way) == 1:
            return [room] if room in pool.runs and pool.front(room) > used.get(room, 0) else None
        for n in range(min(way[0] * unit, room - 1), (way[0] - 1) * unit, -1):
            if n in pool.runs and pool.front(n) > used.get(n, 0):
                rest = exact(way[1:], room - n, used | {n: used.get(n, 0) + 1})
                if rest is not None:
                    return [n, *rest]
        return None

    left = histogram.astype(int)
    for j in sorted(np.flatnonzero(solved), key=lambda j: -solved[j]):
        # No more often than the bins hold rests, whatever the squares say.
        times_left = min(int(solved[j]), *(int(left[b - 1]) // ways[j].count(b) for b in set(ways[j])), 1 << 62)
        while times_left > 0 and (sizes := exact(ways[j], window, {})):
            # Sizes that come twice share a run, so they split it.
            times = min(times_left, *(pool.front(s) // sizes.count(s) for s in sizes), 1 << 62)
            lay(sizes, times)
            times_left -= times
            for s in sizes:
                left[-(-s // unit) - 1] -= times

    while pool.runs:
        sizes, room = [], window
        used: dict[int, int] = {}
        cut = 0
        while room:
            fit = max((n for n in pool.runs if n <= room and pool.front(n) > used.get(n, 0)), default=0)
            if not fit:
                break
            sizes.append(fit)
            used[fit] = used.get(fit, 0) + 1
            room -= fit
        if room:
            cut = min((n for n in pool.runs if n > room and pool.front(n) > used.get(n, 0)), default=0)
            if cut:
                used[cut] = used.get(cut, 0) + 1
        times = min(pool.front(n) // c for n, c in used.items())
        if cut:
            length, offset, lo, hi = pool.take(cut, times)
            lay_room = room
            base = sequence
            lay(sizes, times)
            rows.append((length, offset, lay_room, lo, hi, base, window - lay_room))
            pool.add(cut - lay_room, (length, offset + lay_room, lo, hi))
        else:
            lay(sizes, times)
    return np.array(rows, np.int64).reshape(-1, 7), sequence


def _tokenise(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end, w = np.array([end_id], enc.kind).tobytes(), enc.width
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                texts = [x + end for x in enc.encode([t or "" for t in some.column(1).to_pylist()])]
                tokens = np.array([len(x) // w for x in texts], np.int64)
                pieces = -(-tokens // window)
                row = np.repeat(np.arange(len(texts)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(window, tokens[row] - start)
                # The batch's ids are one buffer; only the bounds of pieces are new.
                bounds = np.concatenate([[0], np.cumsum(length)]) * w
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.astype("<i4").tobytes()), pa.py_buffer(b"".join(texts))])
                columns = [some.column(0).take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(tokens[row]), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def _key(length: np.ndarray, offset: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks below 2**38; lengths and offsets below 4096."""
    return ((length * 4096 + offset) << 38) + rank


def _place(sent, window: int, full_from: int, width: int):
    """Rows with rank to pieces: a rest by the plan, a full window as a sequence of its own. A batch's ids stay
    one array: pieces of a rest come in order of their places in it, so only the bounds between them are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys = sent.value
        for b in batches:
            doc, start, length, tokens, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            ids = pa.concat_arrays([b.column(5)])
            full = np.flatnonzero(length == window)
            row, piece = [np.full(len(full), -1)], [full]
            # A rest's first place, then, while its places don't cover it, the one where the last ended: each is one search
            # for (length, offset, rank) in the sorted plan.
            left, offset = np.flatnonzero(length != window), np.zeros(int((length != window).sum()), np.int64)
            while len(left):
                at = np.searchsorted(keys, _key(length[left], offset, rank[left]), "right") - 1
                t = table[np.maximum(at, 0)]
                if (at < 0).any() or (t[:, 0] != length[left]).any() or (t[:, 1] != offset).any() or (rank[left] >= t[:, 4]).any():
                    raise ValueError("the plan doesn't cover the pieces")
                row.append(at)
                piece.append(left)
                offset = offset + t[:, 2]
                more = offset < length[left]
                left, offset = left[more], offset[more]
            row, piece = np.concatenate(row), np.concatenate(piece)
            offset = np.where(row < 0, 0, table[row, 1])
            order = np.lexsort((offset, piece))
            row, piece, offset = row[order], piece[order], offset[order]
            size = np.where(row < 0, window, table[row, 2])
            sequence = np.where(row < 0, full_from + rank[piece], table[row, 5] + rank[piece] - table[row, 3])
            place = np.where(row < 0, 0, table[row, 6])
            raw = np.frombuffer(ids.buffers()[2], f"<u{width}") if len(ids) and ids.buffers()[2] is not None else np.zeros(0, "<u4")
            first = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset)[[0, -1]] // width if len(ids) else (0, 0)
            bounds = np.concatenate([[0], np.cumsum(size)]) * 4
            data = raw[first[0] : first[1]].astype("<u4")
            if bounds[-1] != data.nbytes:
                raise ValueError("the plan doesn't cover the pieces")
            out = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype("<i4").tobytes()), pa.py_buffer(data)])
            columns = [pa.array(doc[piece]), pa.array(start[piece] + offset), pa.array(size), out, pa.array(tokens[piece]), pa.array(sequence), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = WINDOW, bins: int = BINS) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset: one row for
    each piece. Each id of each document, its end id included, lies in one piece; sequences are numbered from 0
    without gaps and hold at most window ids.

    Null and empty texts are the end id alone, a null id is -1. Rows that share an id are packed each for itself. Very long
    texts are encoded whole and cut. Other columns are ignored, whatever their names. No documents give no rows.
    """
    spark, path = docs.sparkSession, path or default_path()
    pieces = documents(docs).mapInArrow(_tokenise(path, end_id, window), "doc_id long, start long, length int, doc_tokens long, ids binary")
    # Written once: ids are made by the slow step, and places must not change when a task is repeated.
    pieces = stored(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in lengths.collect()}
    rows, sequences = plan({n: c for n, c in counts.items() if n < window}, window, bins)
    blocks = max(1, -(-sum(counts.values()) // BLOCK_DOCS))
    own = pieces.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(blocks)).alias("block"))
    sums = own.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("piece")
    ranks = own.withColumn("at", F.row_number().over(within) - 1).join(sums, ["length", "block"]).select("piece", (F.col("base") + F.col("at")).alias("rank"))
    # Ranks are 16 bytes a piece and are hashed; the ids beside them needn't be sorted.
    placed = pieces.join(ranks.hint("shuffle_hash"), "piece").select("doc_id", "start", "length", "doc_tokens", "rank", "ids")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))] if len(rows) else np.zeros((1, 7), np.int64)
    if window > 4096 or rows[:, 4].max() >= 1 << 38:
        raise ValueError("window or number of rests out of bounds")
    keys = _key(rows[:, 0], rows[:, 1], rows[:, 3])
    return placed.mapInArrow(_place(spark.sparkContext.broadcast((rows, keys)), window, sequences, encoder(path).width), schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
