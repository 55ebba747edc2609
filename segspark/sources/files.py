"""One file a group, written from tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def written(chunks: DataFrame, target: str, suffix: str, make: Callable[[list[tuple[int, bytes, int]]], bytes], *keys: str) -> DataFrame:
    """Rows (keys, chunk_key, cardinality, bitmap), sorted by them within partitions that hold whole groups, to one file a group,
    name=KEY/.../KEY + suffix under target, made of (chunk_key, bitmap, cardinality); keys, path, ids of each. A group is bounded:
    65,536 chunks of 8 KiB at most. A file is written under another name and renamed, so a repeated task leaves whole files."""
    target = target.rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (fs.LocalFileSystem(), target)
        held: list[tuple[int, bytes, int]] = []
        group: tuple[str, ...] | None = None

        def done() -> pd.DataFrame:
            path = "/".join([base, *(f"{k}={g}" for k, g in zip(keys[:-1], group, strict=False)), group[-1]]) + suffix
            where.create_dir(path.rsplit("/", 1)[0], recursive=True)
            staged = f"{path}.{uuid.uuid4().hex}"
            with where.open_output_stream(staged) as f:
                f.write(make(held))
            where.move(staged, path)
            return pd.DataFrame({k: [g] for k, g in zip(keys, group, strict=True)} | {"path": [path], "ids": [sum(n for *_, n in held)]})

        for f in frames:
            for r in f.itertuples(index=False):
                at = tuple(getattr(r, k) for k in keys)
                if group is not None and at != group:
                    yield done()
                    held = []
                group = at
                held.append((int(r.chunk_key), bytes(r.bitmap), int(r.cardinality)))
        if group is not None:
            yield done()

    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField("path", T.StringType()), T.StructField("ids", T.LongType())])
    made = chunks.select(*keys, "chunk_key", "cardinality", "bitmap").mapInPandas(run, schema)
    return chunks.sparkSession.createDataFrame(made.collect(), schema)  # a row a file; the files are written once
