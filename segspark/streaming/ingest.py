"""Structured Streaming over segments.

Ingest and claims write each micro-batch as one commit; a batch that Spark repeats after a failure is told by its
number, kept in a marker beside the segment's log, so it is applied once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.errors import WriteConflictError
from segspark.functions.ids import guarded
from segspark.store import SegmentStore


def _once(store: SegmentStore, query: str, batch: int) -> bool:
    """Whether this is the first time the batch is done."""
    return not store.log.files.exists(store.log.files.path("streams", query, f"{batch:012d}.json"))


def _done(store: SegmentStore, query: str, batch: int, fields: dict[str, Any]) -> None:
    try:
        store.log.files.create(store.log.files.path("streams", query, f"{batch:012d}.json"), json.dumps(fields).encode())
    except WriteConflictError:
        pass


def ingest(store: SegmentStore, query: str, segment: str, namespace: str | None = None, column: str = "id", op: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: add each batch's ids to a segment. op names a column of add or remove; then the row
    with the largest seq of an id decides. Adding again is harmless, so a repeat before the marker is too."""

    def run(batch: DataFrame, number: int) -> None:
        if not _once(store, query, number):
            return
        handle = store.segment(segment, namespace)
        if op is None:
            handle.add_many(batch.select(F.col(column).alias("id")))
        else:
            last = batch.groupBy(guarded(F.col(column), store.max_id).alias("id")).agg(F.max_by(F.col(op) == "add", "seq").alias("add"))
            store.write_ops(handle.namespace, handle.name, last)
        _done(store, query, number, {"segment": segment})

    return run


def claim(store: SegmentStore, query: str, segment: str, sink: Callable[[DataFrame, int], None], namespace: str | None = None, column: str = "id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: claim each batch's ids and hand the winners to sink. An id that was removed
    from the segment meanwhile can be claimed again, which dropDuplicates can't do. The claim is committed together with the
    batch's number, so if the sink fails and Spark repeats the batch, the sink gets the same winners again."""

    def run(batch: DataFrame, number: int) -> None:
        if _once(store, query, number):
            won = store.segment(segment, namespace).claim_many(batch.select(F.col(column).alias("id")), tag=(query, number))
            sink(won, number)
            _done(store, query, number, {"segment": segment})

    return run


def first_seen(stream: DataFrame, within: str = "1 day", time: str = "ts", column: str = "id") -> DataFrame:
    """A stream of each id's first row within a watermark; state is bounded by the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([column])


def day_buckets(events: DataFrame, time: str | Column = "ts", column: str = "user_id", *keys: str) -> DataFrame:
    """keys, day, id: distinct ids by day. Works on streams too, as the day is a column."""
    t = F.col(time) if isinstance(time, str) else time
    return events.select(*keys, F.to_date(t).alias("day"), F.col(column).cast("long").alias("id")).distinct()


def trailing_active(buckets: DataFrame, days: int = 7) -> DataFrame:
    """day, n_active: distinct ids in the days up to and including each day that has a bucket.

    An id counts on a day if its latest day so far is within the window, so each (id, day) is spread over the days
    until the id's next one, at most `days` of them: rows grow by a constant, and there is no range join.
    """
    w = Window.partitionBy("id").orderBy("day")
    nxt = F.date_sub(F.lead("day").over(w), 1)
    last = F.least(F.date_add("day", days - 1), F.coalesce(nxt, F.date_add("day", days - 1)))
    spread = buckets.select("id", "day", last.alias("last")).select("id", F.explode(F.sequence("day", "last")).alias("day"))
    ends = buckets.select("day").distinct()
    return spread.join(F.broadcast(ends), "day", "left_semi").groupBy("day").agg(F.count("*").alias("n_active"))
