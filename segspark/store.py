"""The store: named segments of ids over a shared folder.

    store = SegmentStore(spark, "/data/segments")
    a, b = store.segment("buyers"), store.segment("visitors")
    a.add_many(df)
    a.intersect([b], exclude=[store.segment("opted-out")]).count()

Reads return DataFrames, pinned to the state that the call saw. Small calls (has, count) run their job at once.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.crypto import Keyring, seal, unseal
from segspark.errors import BudgetExceededError, IntegrityError, KeyUnavailableError, NotFoundError, ValidationError, WriteConflictError
from segspark.functions import cost
from segspark.functions.ids import MAX_ID, MAX_WIDE_ID, check_id, chunk_key, id_frame
from segspark.functions.names import check_name, namespace_key
from segspark.metrics import Safe, Sink
from segspark.operators import algebra
from segspark.plans import index as chunks
from segspark.plans.budget import check_budget, resolve_budget
from segspark.plans.tiers import overlay, resolve
from segspark.retry import CONFLICTS, with_retry
from segspark.sources.log import SegmentLog, State
from segspark.sources.roaring import decode_chunks, encode_chunks

OPS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("add", T.BooleanType(), False)])
INDEX = "chunk_key int, cardinality long, bytes long, checksum long"
#: Chunk keys in one folder of a generation; a multiple of them where a wide segment's ids are so sparse that such folders would hold
#: fewer than LEAST_FOLDER_IDS on average: then a folder holds FOLDER_IDS or so, and there are MOST_FOLDERS at most.
KEYS_PER_FOLDER = 256
LEAST_FOLDER_IDS, FOLDER_IDS, MOST_FOLDERS = 1 << 16, 1 << 20, 32
#: Index entries kept on the driver, and chunk keys put in a filter as they are; more are broadcast, 65,536 at most (wide
#: stores keep neither on the driver).
MAX_INDEX_ENTRIES, MAX_LISTED_KEYS = 1 << 22, 2000
#: Ids that one task may sort: 2 MiB.
SMALL_RESULT = 1 << 18
#: Bytes a pending operation takes, for the ceiling on unmerged operations.
OP_BYTES = 16
#: Expiry times below this are taken for seconds by mistake.
MIN_EXPIRES_AT = 1_000_000_000_000


class SegmentStore:
    def __init__(self, spark: SparkSession, root: str, *, clock: Callable[[], float] = time.time, budget: int | bool | None = None, max_pending_bytes: int | None = None, keyring: Keyring | None = None, metrics: Sink | None = None, audit: Sink | None = None, wide: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = SegmentLog(spark, self.root, clock)
        self.budget = budget
        #: Ids are below 2**32, or below 2**47 in a wide store. Files are the same, but a wide segment has any number of chunks and
        #: folders, so its chunk keys stay in tables. All handles on a store should agree; a narrow one refuses wide ids.
        self.wide, self.max_id = wide, MAX_WIDE_ID if wide else MAX_ID
        #: A ceiling on unmerged operations a read takes on; none by default, as Spark spills. MAX_PENDING_BYTES is a usual one.
        self.max_pending_bytes = max_pending_bytes
        resolve_budget(budget)
        #: With a keyring, segments made from now on hold their chunks sealed, each under a key of its own.
        self.keyring = keyring
        self._keys: dict[tuple[str, ...], bytes] = {}
        self._indexes: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._lock = threading.Lock()
        self.metrics, self.audit = Safe(metrics), Safe(audit)

    def segment(self, name: str, namespace: str | None = None, expires_at: int | None = None) -> Segment:
        """A handle; expires_at (epoch ms) makes it read as empty from then on."""
        if expires_at is not None and (isinstance(expires_at, bool) or not isinstance(expires_at, int) or expires_at < MIN_EXPIRES_AT):
            raise ValidationError(f"not an expiry in epoch milliseconds: {expires_at!r}")
        return Segment(self, namespace_key(namespace), check_name(name), expires_at)

    def registry(self) -> DataFrame:
        return self.log.registry()

    # Files of a state

    def generation_path(self, ns: str, name: str, gen: int, attempt: str | None = None) -> str:
        """Of all attempts to write a generation, or of one: no two writers share a folder, and the state says whose counts."""
        return self.log.files.path("cold", f"ns={ns}", f"segment={name}", f"gen={gen}", *([f"attempt={attempt}"] if attempt else []))

    def index_path(self, ns: str, name: str, gen: int, attempt: str | None = None) -> str:
        return self.log.files.path("index", f"ns={ns}", f"segment={name}", f"gen={gen}", *([f"attempt={attempt}"] if attempt else []))

    def warm_path(self, ns: str, name: str) -> str:
        return self.log.files.path("warm", f"ns={ns}", f"segment={name}")

    def empty(self, schema: str = "id long") -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def key(self, s: State) -> bytes | None:
        """The segment's data key; None for one in clear text."""
        if not s.wrapped_keys:
            return None
        if self.keyring is None:
            raise KeyUnavailableError(f"{s.namespace}/{s.segment} is sealed and there is no keyring")
        at = tuple(c["wrapped"] for c in s.wrapped_keys)
        if at not in self._keys:
            self._keys[at] = self.keyring.unwrap(list(s.wrapped_keys))
        return self._keys[at]

    def _with_key(self, s: State) -> State:
        """A new segment of a store with a keyring gets its key before anything is written."""
        if self.keyring is None or s.wrapped_keys or s.current_gen is not None or s.pending:
            return s
        return self.log.update(s.namespace, s.segment, lambda now: None if now.wrapped_keys or now.pending or now.current_gen is not None else {"wrapped_keys": tuple(self.keyring.new_key()[1])})

    def cold(self, s: State, kb: int | None = None) -> DataFrame:
        """id, chunk_key, kb of the current generation, or of one of its folders; kb is the folder, so chunk ranges prune folders."""
        if s.current_gen is None or s.status == "destroyed":
            return self.empty("chunk_key int, id long, kb int")
        return self._generation(s.namespace, s.segment, s.current_gen, s.gen_attempt, self.key(s), kb)

    def _generation(self, ns: str, name: str, gen: int, attempt: str | None, key: bytes | None, kb: int | None = None) -> DataFrame:
        path = self.generation_path(ns, name, gen, attempt)
        rows = self.spark.read.schema("chunk_key int, sealed binary, kb int" if key else "chunk_key int, id long, kb int").parquet(path)
        if kb is not None:
            rows = rows.where(F.col("kb") == kb)
        if key:
            opened = unseal(rows.withColumn("generation", F.lit(gen)), key, ns, name).withColumnRenamed("payload", "bitmap")
            rows = decode_chunks(opened, "kb").select(chunk_key().alias("chunk_key"), "id", "kb")
        return rows

    def folder_keys(self, s: State) -> int | None:
        """Chunk keys in a folder of the current generation; None where that isn't known: a wide one published without stats."""
        if s.gen_stats is None:
            return None if self.wide else KEYS_PER_FOLDER
        return s.gen_stats.get("folder_keys", KEYS_PER_FOLDER)

    def cold_index(self, s: State) -> DataFrame:
        if s.current_gen is None or s.status == "destroyed":
            return self.empty(INDEX)
        return self.spark.read.schema(INDEX).parquet(self.index_path(s.namespace, s.segment, s.current_gen, s.gen_attempt))

    def pending(self, s: State) -> DataFrame | None:
        """id, add, seq of all pending operations; None if there are none. Raises BudgetExceededError beyond the ceiling."""
        if not s.pending or s.status == "destroyed":
            return None
        size = OP_BYTES * sum(p["n"] for p in s.pending)
        if self.max_pending_bytes is not None and size > self.max_pending_bytes:
            raise BudgetExceededError("merging pending operations", size, self.max_pending_bytes)
        key = self.key(s)
        if key:
            return reduce(DataFrame.unionByName, [self._opened(s, p, key) for p in s.pending])
        # One scan for all batches: a batch's folder carries its number.
        folder = self.warm_path(s.namespace, s.segment)
        paths = [p["path"] for p in s.pending]
        return self.spark.read.option("basePath", folder).schema("id long, add boolean, seq long").parquet(*paths)

    def _opened(self, s: State, p: dict[str, Any], key: bytes) -> DataFrame:
        rows = self.spark.read.schema("add boolean, chunk_key int, sealed binary").parquet(p["path"])
        opened = unseal(rows.withColumn("generation", F.lit(p["batch"])), key, s.namespace, s.segment).withColumnRenamed("payload", "bitmap")
        return decode_chunks(opened, "add").select("id", "add", F.lit(p["seq"]).cast("long").alias("seq"))

    def _write_batch(self, s: State, batch: str, path: str, ops: DataFrame) -> int:
        """Write id, add, sealed if the segment is; how many there are."""
        key = self.key(s)
        if key is None:
            ops.select("id", "add").write.parquet(path)
            return self.spark.read.schema(OPS).parquet(path).count()
        rows = encode_chunks(ops, "add").withColumnRenamed("bitmap", "payload").withColumn("generation", F.lit(batch))
        seal(rows, key, s.namespace, s.segment).select("add", "chunk_key", "cardinality", "sealed").write.parquet(path)
        return self.spark.read.schema("cardinality long").parquet(path).agg(F.coalesce(F.sum("cardinality"), F.lit(0))).first()[0]

    def effective(self, s: State) -> DataFrame:
        ops = self.pending(s)
        cold = self.cold(s).select("id")
        return cold if ops is None else overlay(cold, ops)

    def local_index(self, s: State) -> tuple[np.ndarray, np.ndarray]:
        """Chunk keys and cardinalities of the current generation, at most 65,536, kept by generation: a generation
        never changes, so planning a combination of clean segments needs no job."""
        if s.current_gen is None or s.status == "destroyed":
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.index_path(s.namespace, s.segment, s.current_gen, s.gen_attempt)
        with self._lock:
            if at in self._indexes:
                self._indexes[at] = self._indexes.pop(at)
                return self._indexes[at]
        rows = self.cold_index(s).select("chunk_key", "cardinality").orderBy("chunk_key").toArrow()
        got = tuple(rows.column(i).to_numpy().astype(np.int64) for i in range(2))
        with self._lock:
            self._indexes[at] = got
            while len(self._indexes) > 1 and sum(len(k) for k, _ in self._indexes.values()) > MAX_INDEX_ENTRIES:
                self._indexes.pop(next(iter(self._indexes)))
        return got

    def cold_chunks(self, s: State, keys: np.ndarray) -> DataFrame:
        """id of the given chunks: their folders prune files, the keys prune row groups and rows."""
        rows, own = self.cold(s), self.local_index(s)[0]
        if len(keys) < len(own):
            if per := self.folder_keys(s):
                rows = rows.where(F.col("kb").isin(np.unique(keys // per).tolist()))
            if len(keys) <= MAX_LISTED_KEYS:
                rows = rows.where(F.col("chunk_key").isin(keys.tolist()))
            else:
                listed = self.spark.createDataFrame([(int(k),) for k in keys], "chunk_key int")
                rows = rows.join(F.broadcast(listed), "chunk_key", "left_semi")
        return rows.select("id")

    def effective_index(self, s: State) -> DataFrame:
        """chunk_key, cardinality of non-empty chunks: stored counts where nothing is pending, merged ones where something is."""
        index, ops = self.cold_index(s), self.pending(s)
        if ops is None:
            return index.select("chunk_key", "cardinality")
        dirty = ops.select(chunk_key().alias("chunk_key")).distinct()
        dirty = dirty if self.wide else F.broadcast(dirty)
        clean = index.select("chunk_key", "cardinality").join(dirty, "chunk_key", "left_anti")
        own = self.cold(s).join(dirty, "chunk_key", "left_semi").select("id")
        merged = overlay(own, ops).groupBy(chunk_key().alias("chunk_key")).agg(F.count("*").alias("cardinality"))
        return clean.unionByName(merged)

    # Writing

    def _live(self, s: State) -> State:
        """Writing to a destroyed segment makes it anew."""
        if s.status == "destroyed":
            s = self.log.commit(s, status="active", current_gen=None, gen_attempt=None, gen_stats=None, pending=(), claims=(), wrapped_keys=(), retention=None, destroyed_at=None)
        return self._with_key(s)

    def write_ops(self, ns: str, name: str, ops: DataFrame) -> State | None:
        """Append one batch (id, add; one row an id) as a commit. The batch is written once; after a lost race it is
        moved under the next number, as its folder's name is its number."""
        batch = uuid.uuid4().hex
        at = [self.log.files.path("staging", batch)]
        s = self._live(self.log.load(ns, name))
        n = self._write_batch(s, batch, at[0], ops)
        if not n:
            self.log.files.delete(at[0])
            return None
        keys = s.wrapped_keys

        def once() -> State:
            s = self._live(self.log.load(ns, name))
            if s.wrapped_keys != keys:
                raise KeyUnavailableError(f"{ns}/{name} was destroyed meanwhile")
            path = f"{self.warm_path(ns, name)}/seq={s.next_seq}/{batch}"
            if not self.log.files.move(at[0], path):
                raise IntegrityError(f"{at[0]} can't be moved to {path}")
            at[0] = path
            return self.log.commit(s, pending=(*s.pending, {"path": path, "seq": s.next_seq, "n": n, "batch": batch}), next_seq=s.next_seq + 1)

        return with_retry(once, CONFLICTS, lambda e: isinstance(e, WriteConflictError))

    def write_generation(self, ns: str, name: str, gen: int, ids: DataFrame, key: bytes | None = None, distinct: bool = True, ops: DataFrame | None = None) -> dict[str, Any]:
        """Write ids, with pending operations (id, add, seq) on top if there are any, as an attempt at generation gen: files sorted by id in folders of chunk keys (sealed bitmaps of
        chunks with a key), and the index. What it holds, and the attempt's name under "attempt".

        One exchange by 256 chunk keys, in which repeats and operations meet, serves the distinct ids and their order; these are at most
        2**24 ids, and a folder, but where a wide store's folders are wider: such a folder's ids come from several tasks, a file each, so
        no task grows with it. The index is counted on what was written, which needs no exchange of ids.
        """
        attempt = uuid.uuid4().hex
        path, index_path = self.generation_path(ns, name, gen, attempt), self.index_path(ns, name, gen, attempt)
        per = self._folder_keys(ids if ops is None else ids.select("id").unionByName(ops.select("id")))
        folder = F.expr(f"int(chunk_key div {per})").alias("kb")
        if key:
            ids = overlay(ids, ops) if ops is not None else ids
            rows = encode_chunks(ids if distinct else ids.distinct()).withColumnRenamed("bitmap", "payload").withColumn("generation", F.lit(gen))
            seal(rows, key, ns, name).select("chunk_key", "sealed", folder).write.partitionBy("kb").parquet(path)
            if any(n.startswith("kb=") for n in self.log.files.names(path)):
                index = chunks.chunk_index(self._generation(ns, name, gen, attempt, key))
            else:
                index = self.empty(INDEX)
            self._write_index(index, index_path)
        else:
            # What is distinct by (kb, id) stands on the exchange by kb; it needs none of its own.
            kb = F.expr(f"int((id >> 16) div {KEYS_PER_FOLDER})").alias("kb")
            if ops is not None:
                base = ids.select("id", F.lit(True).alias("add"), F.lit(-1).cast("long").alias("seq"))
                rows = base.unionByName(ops.select("id", "add", "seq")).select(kb, "id", "add", "seq").repartition("kb")
                rows = resolve(rows, "kb").where("add").select("id", "kb")
            else:
                rows = ids.select("id", kb).repartition("kb")
                rows = rows if distinct else rows.dropDuplicates(["kb", "id"])
            # A sort by one number is several times quicker than one by folder and id, and the order is the same. The writer adds its
            # own sort by folder, which keeps it; the filter, always true, keeps the optimizer from dropping the first.
            rows = rows.sortWithinPartitions("id").where(F.spark_partition_id() >= 0).select(chunk_key().alias("chunk_key"), "id")
            rows.select("chunk_key", "id", folder).write.partitionBy("kb").parquet(path)
            made = self._generation(ns, name, gen, attempt, None) if any(n.startswith("kb=") for n in self.log.files.names(path)) else self.empty("chunk_key int, id long, kb int")
            self._write_index(chunks.chunk_index(made), index_path)
        row = self.spark.read.schema(INDEX).parquet(index_path).agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("cardinality"), F.lit(0)).alias("cardinality"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"), F.coalesce(F.sum("checksum"), F.lit(0)).alias("checksum")).first()
        return row.asDict() | ({"folder_keys": per} if per != KEYS_PER_FOLDER else {}) | {"attempt": attempt}

    def _folder_keys(self, ids: DataFrame) -> int:
        """Chunk keys in a folder for these ids; in a wide store, a pass over them finds how sparse they are."""
        if not self.wide:
            return KEYS_PER_FOLDER
        n, top = ids.agg(F.approx_count_distinct("id"), F.max("id")).first()
        folders, per = ((top or 0) >> 16) // KEYS_PER_FOLDER + 1, KEYS_PER_FOLDER
        if n < folders * LEAST_FOLDER_IDS:
            most = min(MOST_FOLDERS, max(1, n // FOLDER_IDS))
            while -(-folders * KEYS_PER_FOLDER // per) > most:
                per *= 2
        return per

    def _write_index(self, index: DataFrame, path: str) -> None:
        (index if self.wide else index.repartition(1)).write.parquet(path)

    def verify_generation(self, ns: str, name: str, gen: int, key: bytes | None = None, attempt: str | None = None) -> bool:
        """Read the generation again: each chunk's cardinality and checksum against the index. Without an attempt, the one
        that the state names."""
        if attempt is None:
            s = self.log.load(ns, name)
            attempt = s.gen_attempt if s.current_gen == gen else None
        if not self.log.files.exists(self.generation_path(ns, name, gen, attempt)):
            return False
        stored = self.spark.read.schema(INDEX).parquet(self.index_path(ns, name, gen, attempt))
        made = chunks.chunk_index(self._generation(ns, name, gen, attempt, key))
        one = stored.select("chunk_key", "cardinality", "checksum", F.lit(1).alias("side")).unionByName(made.select("chunk_key", "cardinality", "checksum", F.lit(2).alias("side")))
        return one.groupBy("chunk_key", "cardinality", "checksum").agg(F.sum("side").alias("sides")).where("sides <> 3").limit(1).count() == 0

    def attempts(self, ns: str, name: str, gen: int) -> list[str]:
        return [x[8:] for x in self.log.files.names(self.generation_path(ns, name, gen)) if x.startswith("attempt=")]

    def generations(self, ns: str, name: str) -> list[int]:
        return sorted(int(x[4:]) for x in self.log.files.names(self.log.files.path("cold", f"ns={ns}", f"segment={name}")) if x.startswith("gen="))

    def delete_generation(self, ns: str, name: str, gen: int, attempt: str | None = None) -> None:
        self.log.files.delete(self.generation_path(ns, name, gen, attempt))
        self.log.files.delete(self.index_path(ns, name, gen, attempt))

    def publish(self, ns: str, name: str, gen: int, stats: dict[str, Any] | None = None) -> bool:
        """Make the attempt of stats at gen current unless that or a newer generation is another's; whether it is current.
        Without stats there must be one attempt, and counts come from its index."""
        if stats is None:
            at = self.attempts(ns, name, gen)
            if len(at) != 1:
                raise NotFoundError(f"{ns}/{name}: generation {gen} has {len(at)} attempts")
            stats = {"attempt": at[0]}
        done, attempt = False, stats["attempt"]
        held = {k: v for k, v in stats.items() if k != "attempt"} or None

        def change(s: State) -> dict[str, Any] | None:
            nonlocal done
            if s.status == "destroyed":
                raise ValidationError(f"{ns}/{name} is destroyed")
            newer = s.current_gen is None or s.current_gen < gen
            done = newer or (s.current_gen == gen and s.gen_attempt == attempt)
            return {"current_gen": gen, "gen_attempt": attempt, "gen_stats": held} if newer else None

        self.log.update(ns, name, change)
        self.audit.event("publish", namespace=ns, segment=name, generation=gen, current=done)
        return done

    def bulk_load(self, name: str, ids: DataFrame | Iterable[int], namespace: str | None = None, column: str = "id") -> dict[str, Any]:
        """Unsorted ids with repeats become the next generation and are published: what the generation holds
        replaces the cold tier; pending operations stay on top. Of two loads at once, the later commit wins: a load whose
        number another took writes its ids again under the next."""
        ns, name = namespace_key(namespace), check_name(name)
        for _ in range(CONFLICTS.attempts):
            s = self.log.load(ns, name)
            if s.status == "destroyed":
                raise ValidationError(f"{ns}/{name} is destroyed")
            s = self._with_key(s)
            gens = self.generations(ns, name)
            gen = max([-1 if s.current_gen is None else s.current_gen, *gens]) + 1
            made = self.write_generation(ns, name, gen, id_frame(self.spark, ids, column, distinct=False, most=self.max_id), self.key(s), distinct=False)
            if self.publish(ns, name, gen, made):
                return made | {"generation": gen, "current": True}
            self.delete_generation(ns, name, gen, made["attempt"])
        raise WriteConflictError(f"{ns}/{name}: other loads were first")


class Segment:
    def __init__(self, store: SegmentStore, namespace: str, name: str, expires_at: int | None):
        self.store, self.namespace, self.name, self.expires_at = store, namespace, name, expires_at

    def __repr__(self) -> str:
        return f"Segment({self.namespace}/{self.name})"

    @property
    def expired(self) -> bool:
        """The clock is read once a call; a segment that expires now has expired."""
        return self.expires_at is not None and self.store.log.now() >= self.expires_at

    def state(self) -> State:
        return self.store.log.load(self.namespace, self.name)

    # Reads

    def ids(self) -> DataFrame:
        """The effective ids, unordered."""
        return self.store.empty() if self.expired else self.store.effective(self.state())

    def has(self, value: int) -> bool:
        check_id(value, self.store.max_id)
        if self.expired:
            return False
        s = self.state()
        ops = self.store.pending(s)
        if ops is not None:
            last = ops.where(F.col("id") == value).agg(F.max_by("add", "seq")).first()[0]
            if last is not None:
                return bool(last)
        per = self.store.folder_keys(s)
        kb = (value >> 16) // per if per else None
        return bool(self.store.cold(s, kb).where(F.col("id") == value).limit(1).count())

    def has_batch(self, probes: DataFrame) -> DataFrame:
        return algebra.has_batch(probes, self.ids())

    def count(self, budget: int | bool | None = None) -> int:
        """Exact. Clean chunks come from the index; only chunks with pending operations are read."""
        if self.expired:
            return 0
        s = self.state()
        limit = resolve_budget(budget, self.store.budget)
        if not s.pending and (s.current_gen is None or s.gen_stats):
            n = s.gen_stats["cardinality"] if s.gen_stats else 0
            self.store.metrics.event("count", n=n)
            return n
        ops = self.store.pending(s)
        if ops is not None and limit is not None:
            check_budget("count", ops.select(chunk_key().alias("k")).distinct().count(), limit)
        n = self.store.effective_index(s).agg(F.coalesce(F.sum("cardinality"), F.lit(0))).first()[0]
        self.store.metrics.event("count", n=n)
        return n

    def iterate(self, budget: int | bool | None = None) -> DataFrame:
        """All ids ascending."""
        limit = resolve_budget(budget, self.store.budget)
        if not self.expired and limit is not None:
            check_budget("iterate", self.chunk_keys().count(), limit)
        return self.ids().orderBy("id")

    def chunk_keys(self) -> DataFrame:
        """Keys with cold ids or pending operations."""
        if self.expired:
            return self.store.empty("chunk_key int")
        s = self.state()
        keys, ops = self.store.cold_index(s).select("chunk_key"), self.store.pending(s)
        return keys if ops is None else keys.union(ops.select(chunk_key())).distinct()

    def chunk_index(self) -> DataFrame:
        return self.store.empty("chunk_key int, cardinality long") if self.expired else self.store.effective_index(self.state())

    def size_bytes(self) -> int:
        return self.store.cold_index(self.state()).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    def cost_report(self, workload: dict[str, float] | None = None, topology: str = "A", pricing: cost.Pricing | None = None) -> dict[str, Any]:
        return cost.estimate(self.size_bytes(), workload, topology, pricing)

    def _live(self, others: Sequence[Segment]) -> list[Segment]:
        for o in others:
            if not isinstance(o, Segment) or o.store is not self.store:
                raise ValidationError("operands must be segments of one store")
        return [o for o in others if not o.expired]

    def _combine(self, operands: Sequence[Segment], exclude: Sequence[Segment], any_of: bool, budget: int | bool | None, what: str) -> DataFrame:
        """Which chunks are touched is known before any id is read; over the budget, nothing is."""
        states, outs = [o.state() for o in operands], [e.state() for e in exclude]
        limit = resolve_budget(budget, self.store.budget)
        plan = self._combine_clean if not self.store.wide and not any(s.pending for s in [*states, *outs]) else self._combine_dirty
        ids, drops, most = plan(states, outs, any_of, limit, what, [*operands], [*exclude])
        out = algebra.union(ids, drops) if any_of else algebra.intersect(ids, drops)
        # A result that is known to be small is sorted in one task: no pass to sample ranges.
        return out.coalesce(1).sortWithinPartitions("id") if most is not None and most <= SMALL_RESULT else out.orderBy("id")

    def _combine_clean(self, states, outs, any_of, limit, what, *_) -> tuple[list[DataFrame], list[DataFrame], int | None]:
        """All segments are one generation each: planned on their kept indexes. Also the most ids there can be."""
        store = self.store
        keys, n = np.unique(np.concatenate([store.local_index(s)[0] for s in states]), return_counts=True)
        taken = n >= (1 if any_of else len(states))
        common = keys[taken]
        against = [np.intersect1d(store.local_index(e)[0], common, assume_unique=True) for e in outs]
        units = int(n[taken].sum()) + sum(map(len, against))
        check_budget(what, units, limit)
        store.metrics.event(what, operands=len(states), excludes=len(outs), fetched=len(common), skipped=len(keys) - len(common), units=units)
        if not len(common):
            return [store.empty()], [], 0
        # The smallest first, counted within the chunks taken.
        size = {id(s): int(c[np.isin(k, common, assume_unique=True)].sum()) for s in states for k, c in [store.local_index(s)]}
        if any_of:
            ids, most = [store.cold(s).select("id") for s in states], sum(size.values())
        else:
            ids, most = [store.cold_chunks(s, common) for s in sorted(states, key=lambda s: size[id(s)])], min(size.values())
        return ids, [store.cold_chunks(e, k) for e, k in zip(outs, against, strict=True) if len(k)], most

    def _combine_dirty(self, states, outs, any_of, limit, what, operands, exclude) -> tuple[list[DataFrame], list[DataFrame], int | None]:
        store = self.store
        indexes, against = [o.chunk_keys() for o in operands], [e.chunk_keys() for e in exclude]
        if limit is not None:
            stats = chunks.combine_stats(indexes, against, any_of).first().asDict()
            check_budget(what, stats["units"], limit)
            store.metrics.event(what, operands=len(operands), excludes=len(exclude), **stats)
        ids, drops = [store.effective(s) for s in states], [store.effective(e) for e in outs]
        if any_of:
            return ids, drops, None
        size = [self._hint(s) for s in states]
        ids = [ids[i] for i in sorted(range(len(ids)), key=lambda i: size[i])]
        if len(indexes) > 1:
            # Only chunks that all operands have can hold common ids: at most 65,536 keys, broadcast, prune the rest.
            keys = chunks.common_keys(indexes)
            ids, drops = ([algebra.within_chunks(x, keys, few=not store.wide) for x in xs] for xs in (ids, drops))
        return ids, drops, min(size)

    def _hint(self, s: State) -> int:
        cold = s.gen_stats["cardinality"] if s.gen_stats else self.store.cold_index(s).agg(F.coalesce(F.sum("cardinality"), F.lit(0))).first()[0]
        return cold + sum(p["n"] for p in s.pending)

    def intersect(self, others: Sequence[Segment] = (), exclude: Sequence[Segment] = (), budget: int | bool | None = None) -> DataFrame:
        """Ids in this and all others, ascending; nothing if any of them has expired."""
        live, gone = self._live([self, *others]), self._live(exclude)
        if len(live) < 1 + len(others):
            return self.store.empty()
        return self._combine(live, gone, False, budget, "intersect")

    def union(self, others: Sequence[Segment] = (), exclude: Sequence[Segment] = (), budget: int | bool | None = None) -> DataFrame:
        """Ids in this or any other; expired ones count as empty, the excludes hold all the same."""
        live, gone = self._live([self, *others]), self._live(exclude)
        return self._combine(live, gone, True, budget, "union") if live else self.store.empty()

    def and_not(self, excludes: Sequence[Segment], budget: int | bool | None = None) -> DataFrame:
        if not excludes:
            raise ValidationError("and_not needs at least one exclude")
        gone = self._live(excludes)
        return self.store.empty() if self.expired else self._combine([self], gone, False, budget, "and_not")

    def intersect_efficiency(self, others: Sequence[Segment]) -> dict[str, int]:
        states = [s.state() for s in [self, *others]]
        if self.store.wide or any(s.pending for s in states):
            return chunks.efficiency([s.chunk_keys() for s in [self, *others]]).first().asDict()
        _, n = np.unique(np.concatenate([self.store.local_index(s)[0] for s in states]), return_counts=True)
        return {"fetched": int((n == len(states)).sum()), "skipped": int((n < len(states)).sum())}

    # Writes

    def _write(self, ids: DataFrame | Iterable[int], add: bool) -> State | None:
        rows = id_frame(self.store.spark, ids, most=self.store.max_id).withColumn("add", F.lit(add))
        self.store.metrics.event("add_many" if add else "remove_many")
        return self.store.write_ops(self.namespace, self.name, rows)

    def add(self, value: int) -> None:
        self._write([value], True)

    def remove(self, value: int) -> None:
        self._write([value], False)

    def add_many(self, ids: DataFrame | Iterable[int]) -> None:
        """One batch, one commit: all of it becomes visible at once."""
        self._write(ids, True)

    def remove_many(self, ids: DataFrame | Iterable[int]) -> None:
        self._write(ids, False)

    def claim_many(self, ids: DataFrame | Iterable[int], tag: tuple[str, int] | None = None) -> DataFrame:
        """Add ids and return those that weren't there; each id has one winner among all callers.

        What is new is computed against a state, and committed as that state's next version: if another writer
        commits first, it is computed again from nothing. A tag (a stream's name and the number of its batch) is committed with
        the claim, and the same claim again returns the same winners, as a stream does that repeats its last batch.
        """
        wanted = id_frame(self.store.spark, ids, most=self.store.max_id)

        def once() -> DataFrame:
            s = self.state()
            for c in s.claims if tag else ():
                if (c["query"], c["number"]) == tag:
                    return self._winners(s, c)
            fresh = wanted.join(self.store.effective(s), "id", "left_anti")
            return self._commit_claim(s, fresh, tag)

        return with_retry(once, CONFLICTS, lambda e: isinstance(e, WriteConflictError))

    def _winners(self, s: State, c: dict[str, Any]) -> DataFrame:
        store, key = self.store, self.store.key(s)
        return store._opened(s, c | {"seq": 0}, key).select("id") if key else store.spark.read.schema(OPS).parquet(c["path"]).select("id")

    def _commit_claim(self, s: State, fresh: DataFrame, tag: tuple[str, int] | None) -> DataFrame:
        store, batch = self.store, uuid.uuid4().hex
        s = store._live(s)
        path = f"{store.warm_path(self.namespace, self.name)}/seq={s.next_seq}/{batch}"
        n = store._write_batch(s, batch, path, fresh.select("id", F.lit(True).alias("add")))
        entry = {"path": path, "seq": s.next_seq, "n": n, "batch": batch}
        won = store.pending(replace(s, pending=(entry,))).select("id")
        if n:
            changes: dict[str, Any] = {"pending": (*s.pending, entry), "next_seq": s.next_seq + 1}
            old, copy = [], None
            if tag:
                # A copy of its own, as a compaction may fold the batch before the stream asks again.
                copy = store.log.files.path("claims", f"{self.namespace}~{self.name}", batch)
                store._write_batch(s, batch, copy, won.select("id", F.lit(True).alias("add")))
                old = [c for c in s.claims if c["query"] == tag[0]]
                changes["claims"] = (*(c for c in s.claims if c["query"] != tag[0]), {"query": tag[0], "number": tag[1], "path": copy, "batch": batch})
            try:
                store.log.commit(s, **changes)
            except WriteConflictError:
                for gone in filter(None, (path, copy)):
                    store.log.files.delete(gone)
                raise
            for c in old:
                store.log.files.delete(c["path"])
        store.metrics.event("claim_many", won=n)
        return won

    def _into(self, dest: Segment, result: DataFrame, what: str) -> None:
        dest._write(result, True)
        self.store.metrics.event(what)

    def intersect_into(self, dest: Segment, others: Sequence[Segment] = (), exclude: Sequence[Segment] = ()) -> None:
        """Add the result to dest; what dest has stays."""
        self._into(dest, self.intersect(others, exclude), "intersect_into")

    def union_into(self, dest: Segment, others: Sequence[Segment] = (), exclude: Sequence[Segment] = ()) -> None:
        self._into(dest, self.union(others, exclude), "union_into")

    def and_not_into(self, dest: Segment, excludes: Sequence[Segment]) -> None:
        self._into(dest, self.and_not(excludes), "and_not_into")


def fleet(store: SegmentStore, namespace: str | None = None, without: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """namespace, segment, id of all live registered segments, for searches and exports.

    Segments in clear text come from one scan over all generations and one over all operations, whose folders are
    columns; the registry says which of them count. So the plan's size doesn't depend on how many segments there are,
    and a filter on ids or names reaches both scans. Sealed segments need their keys and are added one by one.
    """
    spark, files = store.spark, store.log.files
    registry = store.registry().where("status <> 'destroyed'")
    if namespace is not None:
        registry = registry.where(F.col("namespace") == namespace_key(namespace))
    without = sorted(without)
    if without:
        left_out = spark.createDataFrame(without, "namespace string, segment string")
        registry = registry.join(F.broadcast(left_out), ["namespace", "segment"], "left_anti")
    clear = registry.where("size(wrapped_keys) = 0")
    keys = ["namespace", "segment"]
    cold, ops = store.empty("namespace string, segment string, id long"), None
    if files.names(files.path("cold")):
        rows = spark.read.schema("id long, ns string, segment string, gen long, attempt string, kb int").parquet(files.path("cold")).withColumnRenamed("ns", "namespace")
        current = clear.where("current_gen is not null").select(*keys, F.col("current_gen").alias("gen"), F.col("gen_attempt").alias("attempt"))
        cold = rows.where("id is not null").join(current, [*keys, "gen", "attempt"], "left_semi").select(*keys, "id")
    if files.names(files.path("warm")):
        rows = spark.read.schema("id long, add boolean, ns string, segment string, seq long").parquet(files.path("warm")).withColumnRenamed("ns", "namespace")
        # A batch's folder, too: a claim that lost its race and then its driver leaves one that doesn't count.
        rows = rows.withColumn("batch", F.regexp_extract("_metadata.file_path", "/seq=[0-9]+/([0-9a-f]+)/", 1))
        pending = clear.select(*keys, F.explode("pending").alias("p")).select(*keys, "p.seq", "p.batch")
        ops = rows.where("id is not null").join(pending, [*keys, "seq", "batch"], "left_semi").select(*keys, "id", "add", "seq")
    out = cold if ops is None else overlay(cold, ops, *keys)
    for r in registry.where("size(wrapped_keys) > 0").select(*keys).toLocalIterator():
        ids = store.effective(store.log.load(r["namespace"], r["segment"]))
        out = out.unionByName(ids.select(F.lit(r["namespace"]).alias("namespace"), F.lit(r["segment"]).alias("segment"), "id"))
    return out


def fleet_dirty(store: SegmentStore) -> DataFrame:
    """namespace, segment, dirty: chunks with pending operations of all live segments, sealed ones too (their chunk keys are in
    clear), in one scan of the batches that the registry names."""
    spark, files, keys = store.spark, store.log.files, ["namespace", "segment"]
    if not files.names(files.path("warm")):
        return store.empty("namespace string, segment string, dirty long")
    rows = spark.read.schema("id long, chunk_key int, ns string, segment string, seq long").parquet(files.path("warm")).withColumnRenamed("ns", "namespace")
    rows = rows.withColumn("batch", F.regexp_extract("_metadata.file_path", "/seq=[0-9]+/([0-9a-f]+)/", 1))
    held = store.registry().where("status <> 'destroyed'").select(*keys, F.explode("pending").alias("p")).select(*keys, "p.seq", "p.batch")
    chunk = F.coalesce(chunk_key(), F.col("chunk_key")).alias("chunk")
    return rows.join(held, [*keys, "seq", "batch"], "left_semi").select(*keys, chunk).groupBy(*keys).agg(F.countDistinct("chunk").alias("dirty"))


__all__ = ["Segment", "SegmentStore", "fleet", "fleet_dirty"]
