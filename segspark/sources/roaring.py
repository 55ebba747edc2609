"""The public portable layout of compressed 32-bit bitmaps, in numpy: for interchange, not for storage.

Containers of 65,536 values each are sorted 16-bit arrays (up to 4,096 values), bitmaps of 8 KiB, or runs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.errors import IntegrityError
from segspark.sources.files import written

# Fixed values of the layout.
COOKIE, COOKIE_RUNS = 12346, 12347
ARRAY_MAX, BITMAP_BYTES, NO_OFFSETS_BELOW = 4096, 8192, 4
#: Ids of a chunk at most, and of the chunks decoded at a time at least.
CHUNK_IDS = 1 << 16


def _container(low: np.ndarray) -> tuple[bytes, bool]:
    """The smallest form of sorted distinct 16-bit values, and whether it is runs."""
    breaks = np.flatnonzero(np.diff(low) != 1)
    starts, ends = low[np.concatenate([[0], breaks + 1])], low[np.concatenate([breaks, [len(low) - 1]])]
    plain = 2 * len(low) if len(low) <= ARRAY_MAX else BITMAP_BYTES
    if 2 + 4 * len(starts) < plain:
        return struct.pack("<H", len(starts)) + np.stack([starts, ends - starts], axis=1).astype("<u2").tobytes(), True
    if len(low) <= ARRAY_MAX:
        return low.astype("<u2").tobytes(), False
    bits = np.zeros(1 << 16, bool)
    bits[low] = True
    return np.packbits(bits, bitorder="little").tobytes(), False


def encode(ids: np.ndarray) -> bytes:
    """Any ids, repeats and order don't matter."""
    ids = np.unique(np.asarray(ids, np.int64))
    if len(ids) and (ids[0] < 0 or ids[-1] >= 1 << 32):
        raise IntegrityError("ids beyond 32 bits")
    keys, first = np.unique(ids >> 16, return_index=True)
    bounds = [*first.tolist(), len(ids)]
    made = [_container(ids[a:b] & 0xFFFF) for a, b in zip(bounds, bounds[1:], strict=False)]
    n, runs = len(keys), [r for _, r in made]
    head = b"".join(struct.pack("<HH", k, b - a - 1) for k, a, b in zip(keys.tolist(), bounds, bounds[1:], strict=False))
    if any(runs):
        top = struct.pack("<I", COOKIE_RUNS | (n - 1) << 16) + np.packbits(runs, bitorder="little").tobytes()
    else:
        top = struct.pack("<II", COOKIE, n)
    offsets = b""
    if not any(runs) or n >= NO_OFFSETS_BELOW:
        at = len(top) + len(head) + 4 * n
        for data, _ in made:
            offsets += struct.pack("<I", at)
            at += len(data)
    return top + head + offsets + b"".join(d for d, _ in made)


def _parse(data: bytes) -> Iterator[tuple[int, int, bool, int]]:
    """Key, cardinality, whether runs, and place of each container."""
    try:
        cookie = struct.unpack_from("<I", data)[0]
        if cookie & 0xFFFF == COOKIE_RUNS:
            n = (cookie >> 16) + 1
            flags = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 4), bitorder="little")[:n].astype(bool)
            at = 4 + (n + 7) // 8
            offsets = n >= NO_OFFSETS_BELOW
        elif cookie == COOKIE:
            n, flags, at, offsets = struct.unpack_from("<I", data, 4)[0], None, 8, True
            if n > 1 << 16:
                raise IntegrityError("too many containers")
            flags = np.zeros(n, bool)
        else:
            raise IntegrityError("not a portable bitmap")
        heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(-1, 2).astype(int)
    except (struct.error, ValueError) as e:
        raise IntegrityError(f"bitmap cut short: {e}") from e
    if (np.diff(heads[:, 0]) <= 0).any():
        raise IntegrityError("container keys don't ascend")
    at += 4 * n + (4 * n if offsets else 0)
    for (key, card), runs in zip(heads.tolist(), flags.tolist(), strict=True):
        card += 1
        yield key, card, runs, at
        if runs:
            if at + 2 > len(data):
                raise IntegrityError("bitmap cut short")
            at += 2 + 4 * struct.unpack_from("<H", data, at)[0]
        else:
            at += 2 * card if card <= ARRAY_MAX else BITMAP_BYTES
        if at > len(data):
            raise IntegrityError("bitmap cut short")


def decode(data: bytes) -> np.ndarray:
    """The ids ascending; IntegrityError for bytes that aren't a bitmap."""
    out = []
    for key, card, runs, at in _parse(data):
        if runs:
            n = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * n, at + 2).reshape(-1, 2).astype(np.int64)
            low = np.repeat(pairs[:, 0], pairs[:, 1] + 1) + np.concatenate([np.arange(k + 1) for k in pairs[:, 1]] or [np.zeros(0, np.int64)])
        elif card <= ARRAY_MAX:
            low = np.frombuffer(data, "<u2", card, at).astype(np.int64)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, BITMAP_BYTES, at), bitorder="little"))
        if len(low) != card or (np.diff(low) <= 0).any() or (len(low) and low[-1] > 0xFFFF):
            raise IntegrityError(f"container {key} contradicts its head")
        out.append(low + (key << 16))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count(data: bytes) -> int:
    """From the heads alone."""
    return sum(card for _, card, _, _ in _parse(data))


def has(data: bytes, value: int) -> bool:
    for key, card, runs, at in _parse(data):
        if key == value >> 16:
            low = value & 0xFFFF
            if runs:
                n = struct.unpack_from("<H", data, at)[0]
                pairs = np.frombuffer(data, "<u2", 2 * n, at + 2).reshape(-1, 2).astype(int)
                i = int(np.searchsorted(pairs[:, 0], low, "right")) - 1
                return i >= 0 and low <= pairs[i, 0] + pairs[i, 1]
            if card <= ARRAY_MAX:
                a = np.frombuffer(data, "<u2", card, at)
                i = int(np.searchsorted(a, low))
                return i < card and int(a[i]) == low
            return bool(data[at + (low >> 3)] >> (low & 7) & 1)
    return False


def encode_chunks(ids: DataFrame, *keys: str) -> DataFrame:
    """keys, chunk_key, cardinality, bitmap: a portable bitmap of each chunk's lower halves. A chunk is at most
    65,536 ids, so a group is bounded; chunks of a few ids each go through Python many at a time."""
    own = [*keys, "chunk_key"]

    def made(f: pd.DataFrame) -> pd.DataFrame:
        """Whole groups, one after another."""
        first = np.flatnonzero(_turns(f, own))
        lows = [np.unique(x) for x in np.split(f["id"].to_numpy() & 0xFFFF, first[1:])]
        return f[own].iloc[first].assign(cardinality=[len(x) for x in lows], bitmap=[encode(x) for x in lows])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last group, which may go on in the next frame
        for f in frames:
            if not len(f):
                continue
            seam = pd.concat([held[-1].iloc[-1:], f]) if held else f
            first = np.flatnonzero(_turns(seam, own)[1 if held else 0 :])
            if held and not len(first):
                held.append(f)
                continue
            if whole := [*held, *([f.iloc[: first[-1]]] if first[-1] else [])]:
                yield made(pd.concat(whole))
            held = [f.iloc[first[-1] :]]
        if held:
            yield made(pd.concat(held))

    rows = ids.select(*keys, F.shiftright("id", 16).cast("int").alias("chunk_key"), "id")
    schema = T.StructType([rows.schema[k] for k in own] + [T.StructField("cardinality", T.LongType()), T.StructField("bitmap", T.BinaryType())])
    return rows.repartition(*own).sortWithinPartitions(*own).mapInPandas(run, schema)


def _turns(f: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Whether a row's columns differ from those of the row before; True for the first row. Nulls are equal."""
    out = np.zeros(len(f), bool)
    for c in columns:
        v, none = f[c].to_numpy(), f[c].isna().to_numpy()
        out[1:] |= (none[1:] != none[:-1]) | ((v[1:] != v[:-1]) & ~none[1:])
    out[:1] = True
    return out


def decode_chunks(chunks: DataFrame, *keys: str) -> DataFrame:
    """keys, id from keys, chunk_key, bitmap."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held, n, start = [], 0, 0

            def done(stop: int, f=f) -> pd.DataFrame:
                counts = [len(x) for x in held]
                return pd.DataFrame({k: np.repeat(f[k].to_numpy()[start:stop], counts) for k in keys} | {"id": np.concatenate(held)})

            for i, (key, data) in enumerate(zip(f["chunk_key"], f["bitmap"], strict=True)):
                held.append(decode(data) + (int(key) << 16))
                n += len(held[-1])
                if n >= CHUNK_IDS:
                    yield done(i + 1)
                    held, n, start = [], 0, i + 1
            if held:
                yield done(len(f))

    schema = T.StructType([chunks.schema[k] for k in keys] + [T.StructField("id", T.LongType())])
    return chunks.select(*keys, "chunk_key", "bitmap").mapInPandas(run, schema)


def join(chunks: list[tuple[int, bytes]]) -> bytes:
    """One portable bitmap from bitmaps of single chunks (chunk key, bitmap of the lower halves), keys ascending. Containers
    are copied, not decoded."""
    parts = []
    for key, data in chunks:
        for _, card, runs, at in _parse(data):
            size = 2 + 4 * struct.unpack_from("<H", data, at)[0] if runs else 2 * card if card <= ARRAY_MAX else BITMAP_BYTES
            parts.append((key, card, runs, data[at : at + size]))
    n, runs = len(parts), [r for _, _, r, _ in parts]
    head = b"".join(struct.pack("<HH", k, card - 1) for k, card, _, _ in parts)
    top = struct.pack("<I", COOKIE_RUNS | (n - 1) << 16) + np.packbits(runs, bitorder="little").tobytes() if any(runs) else struct.pack("<II", COOKIE, n)
    offsets, at = [], len(top) + len(head) + 4 * n
    for *_, data in parts:
        offsets.append(at)
        at += len(data)
    table = struct.pack(f"<{n}I", *offsets) if not any(runs) or n >= NO_OFFSETS_BELOW else b""
    return b"".join([top, head, table, *(d for *_, d in parts)])


def write_files(chunks: DataFrame, target: str, *keys: str) -> DataFrame:
    """Rows of encode_chunks, sorted by keys and chunk within partitions that hold whole groups, to one portable file a group,
    namespace=KEY/KEY.roaring under target for keys namespace and segment; keys, path, ids of each."""
    return written(chunks, target, ".roaring", lambda held: join([(k, b) for k, b, _ in held]), *keys)


def read_files(spark: SparkSession, target: str) -> DataFrame:
    """namespace, segment, id of the portable files under target, namespace=NAMESPACE/SEGMENT.roaring."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                got = decode(r.content)
                yield pd.DataFrame({"namespace": [r.namespace] * len(got), "segment": [r.segment] * len(got), "id": got})

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.roaring").load(target)
    parts = F.split("path", "/")
    named = rows.select(F.regexp_replace(F.element_at(parts, -2), "^namespace=", "").alias("namespace"), F.regexp_replace(F.element_at(parts, -1), r"\.roaring$", "").alias("segment"), "content")
    return named.mapInPandas(run, "namespace string, segment string, id long")
