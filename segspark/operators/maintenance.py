"""Compaction, collection of old generations, retention, dropping, erasure, consistency and export.

Each works on one segment's log by optimistic commits; selection over the fleet is a DataFrame query.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.errors import ValidationError, WriteConflictError
from segspark.functions.ids import check_id
from segspark.functions.names import check_name, namespace_key
from segspark.functions.shards import shard_column
from segspark.plans.budget import check_budget
from segspark.sources.log import State
from segspark.store import MIN_EXPIRES_AT, SegmentStore, fleet, fleet_dirty

LEASE_MS = 10 * 60_000
#: A segment that failed this often rests for this long.
QUARANTINE_FAILURES, QUARANTINE_MS = 5, 5 * 60_000
RETIRE_LIMIT = 100
TOMBSTONE_GRACE_MS = 24 * 3_600_000
DAY_MS = 86_400_000
LOOKBACK_BUCKETS = 7
MAX_SCAN_SEGMENTS = 250_000


@dataclass(frozen=True)
class Outcome:
    namespace: str
    segment: str
    compacted: bool
    reason: str | None = None
    from_gen: int | None = None
    to_gen: int | None = None
    purged: int = 0
    survived: int = 0
    dirty: int = 0


def compact(store: SegmentStore, name: str, namespace: str | None = None, owner: str | None = None, keep: int = 1, verify: bool = True, renew_s: float = LEASE_MS / 3000, step: Callable[[str], None] = lambda _: None) -> Outcome:
    """Fold pending operations into the next generation.

    Each attempt writes a folder of its own, which only its commit makes count, and its lease is renewed while it runs, so a
    worker that outlives its lease changes and deletes nothing of another's. The commit that makes it current also drops exactly the operations it folded, so there is no moment at which
    an answer changes, and a crash anywhere leaves the old state with files that nothing refers to. step is called
    before each stage (for tests of crashes).
    """
    ns, name = namespace_key(namespace), check_name(name)
    log, owner = store.log, owner or uuid.uuid4().hex
    s = log.load(ns, name)

    def no(reason: str, **more: Any) -> Outcome:
        return Outcome(ns, name, False, reason, from_gen=s.current_gen, **more)

    if s.status == "destroyed":
        return no("destroyed")
    if not s.pending:
        return no("clean")
    if s.lease_owner not in (None, owner) and (s.lease_expires_at or 0) > log.now():
        return no("leased-by-other")
    step("lease")
    try:
        pinned = log.commit(s, status="compacting", lease_owner=owner, lease_expires_at=log.now() + LEASE_MS)
    except WriteConflictError:
        return no("leased-by-other")
    gen = 0 if pinned.current_gen is None else pinned.current_gen + 1
    with _renewed(store, ns, name, owner, renew_s):
        step("stage")
        key = store.key(pinned)
        made = store.write_generation(ns, name, gen, store.cold(pinned).select("id"), key, ops=store.pending(pinned))
        attempt = made["attempt"]
        step("verify")
        ok = not verify or store.verify_generation(ns, name, gen, key, attempt)
    if not ok:
        store.delete_generation(ns, name, gen, attempt)
        log.update(ns, name, lambda now: {"status": "active", "lease_owner": None, "lease_expires_at": None} if now.lease_owner == owner else None)
        return no("stage-conflict")
    folded = {p["path"] for p in pinned.pending}
    step("commit")
    lost: str | None = None

    def change(now: State) -> dict[str, Any] | None:
        nonlocal lost
        lost = "destroyed" if now.status == "destroyed" else "superseded" if now.current_gen != pinned.current_gen else "lease-lost" if now.lease_owner != owner else None
        if lost:
            return None
        rest = tuple(p for p in now.pending if p["path"] not in folded)
        return {"current_gen": gen, "gen_attempt": attempt, "gen_stats": {k: v for k, v in made.items() if k != "attempt"}, "pending": rest, "status": "active", "lease_owner": None, "lease_expires_at": None, "last_compacted_at": log.now(), "failures": 0}

    after = log.update(ns, name, change)
    if lost:
        store.delete_generation(ns, name, gen, attempt)
        return no(lost)
    step("purge")
    for path in folded:
        log.files.delete(path)
    store.audit.event("compact", namespace=ns, segment=name, generation=gen)
    collect_generations(store, name, ns, keep)
    return Outcome(ns, name, True, None, pinned.current_gen, gen, len(folded), len(after.pending), len(folded) + len(after.pending))


@contextmanager
def _renewed(store: SegmentStore, ns: str, name: str, owner: str, every_s: float) -> Iterator[None]:
    """Keep a lease on a segment alive while the body runs."""
    done = threading.Event()

    def run() -> None:
        while not done.wait(every_s):
            try:
                store.log.update(ns, name, lambda now: {"lease_expires_at": store.log.now() + LEASE_MS} if now.lease_owner == owner and now.status == "compacting" else None)
            except Exception:  # the commit at the end finds out whether the lease still holds
                continue

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def collect_generations(store: SegmentStore, name: str, namespace: str | None = None, keep: int = 1) -> list[int]:
    """Delete generations below the current one but the newest keep; all of a destroyed segment; none where no
    generation is current. What went. Attempts that lost against a generation go with it: their writers may still be at work on them."""
    ns = namespace_key(namespace)
    s = store.log.load(ns, name)
    gens = store.generations(ns, name)
    if s.status == "destroyed":
        gone = gens
    elif s.current_gen is None:
        gone = []
    else:
        below = sorted((g for g in gens if g < s.current_gen), reverse=True)
        gone = below[keep:]
    for g in gone:
        store.delete_generation(ns, name, g)
    return sorted(gone)


def generations_to_collect(generations: DataFrame, registry: DataFrame, keep: int = 1) -> DataFrame:
    """The same over a fleet: rows (segment, gen) against (segment, current_gen, status)."""
    both = generations.join(registry.select("segment", "current_gen", "status"), "segment")
    rank = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("gen")))
    old = both.where("status <> 'destroyed' and current_gen is not null and gen < current_gen").withColumn("at", rank).where(F.col("at") > keep)
    return old.select("segment", "gen").unionByName(both.where("status = 'destroyed'").select("segment", "gen"))


def compactable(registry: DataFrame, now_ms: int, min_dirty: int = 1, limit: int | None = None) -> DataFrame:
    """namespace, segment, dirty of segments worth compacting, the dirtiest first, then those not compacted for
    longest. registry has dirty, status, failures, updated_at, last_compacted_at."""
    rests = (F.col("failures") >= QUARANTINE_FAILURES) & (F.col("updated_at") > now_ms - QUARANTINE_MS)
    rows = registry.where((F.col("status") != "destroyed") & (F.col("dirty") >= min_dirty) & ~rests)
    rows = rows.orderBy(F.desc("dirty"), F.coalesce("last_compacted_at", F.lit(0)), "namespace", "segment").select("namespace", "segment", "dirty")
    return rows.limit(limit) if limit is not None else rows


def skip_reason(status: Column, dirty: Column, failures: Column, updated_at: Column, now_ms: int) -> Column:
    """Why a cycle leaves a segment alone; "due" for one that it takes."""
    rests = (failures >= QUARANTINE_FAILURES) & (updated_at > now_ms - QUARANTINE_MS)
    return F.when(status == "destroyed", "destroyed").when(dirty == 0, "clean").when(rests, "quarantined").otherwise("due")


def run_compaction_cycle(store: SegmentStore, max_segments: int = 64, min_dirty: int = 1, shard: tuple[int, int] | None = None, workers: int = 4) -> list[Outcome]:
    """Compact what is most worth it, by chunks with pending operations. One segment's failure is noted on it and doesn't stop the others."""
    registry = store.registry().join(fleet_dirty(store), ["namespace", "segment"], "left")
    # A segment whose batches can't be read is tried all the same, and the failure noted on it.
    registry = registry.withColumn("dirty", F.coalesce("dirty", F.when(F.size("pending") > 0, F.lit(min_dirty)).otherwise(0).cast("long")))
    if shard:
        registry = registry.where(shard_column(F.col("namespace"), F.col("segment"), shard[1]) == shard[0])
    rows = [(r["namespace"], r["segment"]) for r in compactable(registry, store.log.now(), min_dirty, max_segments).collect()]

    def one(at: tuple[str, str]) -> Outcome:
        owner = uuid.uuid4().hex
        try:
            return compact(store, at[1], at[0], owner=owner)
        except Exception as e:
            # Only what this worker holds is let go of.
            store.log.update(*at, lambda s: {"failures": s.failures + 1} | ({"status": "active", "lease_owner": None} if s.lease_owner == owner and s.status == "compacting" else {}))
            return Outcome(*at, False, f"error: {e}")

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return list(pool.map(one, rows))


# Retention


def policy_state(present: Column, is_object: Column, value: Column) -> Column:
    """none, invalid or ok: a missing policy or key is none; anything but a whole number of epoch milliseconds
    is invalid, never "keep for ever"."""
    number = value.try_cast("long") if hasattr(value, "try_cast") else value.cast("long")
    whole = value.rlike(r"^-?\d+$") & number.isNotNull()
    return (
        F.when(~present, "none").when(~is_object, "invalid").when(value.isNull(), "none")
        .when(whole & (number >= MIN_EXPIRES_AT), "ok").otherwise("invalid")
    )


def read_policy(retention: Any) -> tuple[str, int | None]:
    if retention is None:
        return "none", None
    if not isinstance(retention, dict):
        return "invalid", None
    if "expiresAt" not in retention:
        return "none", None
    v = retention["expiresAt"]
    return ("ok", v) if isinstance(v, int) and not isinstance(v, bool) and v >= MIN_EXPIRES_AT else ("invalid", None)


def set_retention(store: SegmentStore, name: str, expires_at: int, namespace: str | None = None) -> None:
    """Registers the segment if it isn't; it then has no generation."""
    if read_policy({"expiresAt": expires_at})[0] != "ok":
        raise ValidationError(f"not an expiry in epoch milliseconds: {expires_at!r}")

    def change(s: State) -> dict[str, Any]:
        if s.status == "destroyed":
            raise ValidationError(f"{name} is destroyed")
        return {"retention": (s.retention or {}) | {"expiresAt": expires_at}}

    ns, name = namespace_key(namespace), check_name(name)
    # The mark comes first: one too many is dropped by the sweep, one too few would wait for a scan of the fleet.
    store.log.files.touch(due_path(store, expires_at // DAY_MS, ns, name))
    store.log.update(ns, name, change)


def due_path(store: SegmentStore, bucket: int, *at: str) -> str:
    """The due index: a folder for each day with a mark for each segment whose expiry was set to that day."""
    return store.log.files.path("due", f"{bucket:08d}", *(["~".join(at)] if at else []))


def due_marks(store: SegmentStore, now_ms: int, lookback: int = LOOKBACK_BUCKETS) -> list[tuple[int, str, str]]:
    """(bucket, namespace, segment) marked for today and the days before it; other days aren't listed."""
    return [(day, *mark.split("~", 1)) for day in due_buckets_at(now_ms, lookback) for mark in store.log.files.names(due_path(store, day))]


def get_retention(store: SegmentStore, name: str, namespace: str | None = None) -> tuple[str, int | None]:
    return read_policy(store.log.load(namespace, name).retention)


def clear_retention(store: SegmentStore, name: str, namespace: str | None = None) -> None:
    def change(s: State) -> dict[str, Any] | None:
        if not s.registered or not s.retention or "expiresAt" not in s.retention:
            return None
        return {"retention": {k: v for k, v in s.retention.items() if k != "expiresAt"} or None}

    store.log.update(namespace_key(namespace), check_name(name), change)


def due_bucket(expires_at: Column) -> Column:
    """The day an expiry falls on; rows partitioned by it are found without a scan of the fleet."""
    return F.floor(expires_at / DAY_MS)


def due_buckets_at(now_ms: int, lookback: int = LOOKBACK_BUCKETS) -> list[int]:
    day = now_ms // DAY_MS
    return list(range(day - lookback, day + 1))


def due(rows: DataFrame, now_ms: int) -> DataFrame:
    """Rows with expires_at that is now or past."""
    return rows.where((F.col("expires_at") >= MIN_EXPIRES_AT) & (F.col("expires_at") <= now_ms))


def due_by_index(rows: DataFrame, now_ms: int, lookback: int = LOOKBACK_BUCKETS) -> DataFrame:
    """Rows with bucket and expires_at that a sweep by the due index takes: a filter on the day, then on the time."""
    return due(rows.where(F.col("bucket").isin(due_buckets_at(now_ms, lookback))), now_ms)


LEDGER = "namespace string, segment string, action string, expires_at long, reason string, fault string"


def retire_expired(store: SegmentStore, limit: int = RETIRE_LIMIT, dry_run: bool = False, grace_ms: int = TOMBSTONE_GRACE_MS, scan: bool = True, lookback: int = LOOKBACK_BUCKETS) -> dict[str, Any]:
    """Drop segments whose time has come, at most limit attempts, and forget tombstones after their grace.
    The policy is read again just before each drop. Returns counts and a ledger DataFrame.

    A scan asks the whole registry, of which only what is due comes to the driver, at most limit rows of each kind; it also
    finds invalid policies and tombstones, and puts marks that are missing. Without one, only the due index of the last days is read.
    """
    now, ledger, eligible, files = store.log.now(), [], 0, store.log.files
    limited = False
    if scan:
        registry = store.registry()
        value = registry["retention"]["expiresAt"]
        rows = registry.select("namespace", "segment", "status", "destroyed_at", value.cast("long").alias("expires_at"), policy_state(F.col("retention").isNotNull(), F.lit(True), value).alias("policy"))
        live = rows.where("status <> 'destroyed'")
        wrong = live.where("policy = 'invalid'").orderBy("namespace", "segment").limit(limit).collect()
        ledger += [(r["namespace"], r["segment"], "skipped", None, "invalid-policy", None) for r in wrong]
        found = due(live.where("policy = 'ok'"), now).orderBy("expires_at", "namespace", "segment").limit(limit + 1).collect()
        at = [(r["expires_at"] // DAY_MS, r["namespace"], r["segment"]) for r in found]
        gone = rows.where((F.col("status") == "destroyed") & (F.col("destroyed_at") + grace_ms <= now)).orderBy("destroyed_at", "namespace", "segment").limit(limit)
        for r in gone.collect() if not dry_run else ():
            s = store.log.load(r["namespace"], r["segment"])
            if s.status == "destroyed" and store.log.forget(s):
                ledger.append((r["namespace"], r["segment"], "forgot", r["expires_at"], None, None))
    else:
        at = due_marks(store, now, lookback)
    for bucket, ns, name in at:
        if eligible >= limit:
            limited = True
            break
        s = store.log.load(ns, name)
        state, expires = read_policy(s.retention)
        mark = due_path(store, bucket, ns, name)
        if s.status == "destroyed" or state != "ok" or expires > now:
            if scan:
                eligible += 1
                ledger.append((ns, name, "skipped", expires, "policy-changed", None))
            elif (s.status == "destroyed" or state != "ok" or expires // DAY_MS != bucket) and not dry_run:
                files.delete(mark)  # another mark, or none, holds now
            continue
        eligible += 1
        if dry_run:
            ledger.append((ns, name, "would-retire", expires, None, None))
            continue
        try:
            out = drop(store, name, ns, confirm=name)
            ledger.append((ns, name, "retired", expires, out["reason"], None))
            files.delete(mark)
        except Exception as e:
            files.touch(mark)
            ledger.append((ns, name, "failed", expires, None, str(e)))
    return {"eligible": eligible, "limited": limited, "ledger": store.spark.createDataFrame(ledger, LEDGER)}


# Dropping and erasing


def drop(store: SegmentStore, name: str, namespace: str | None = None, *, confirm: str, dry_run: bool = False, sweeps: int = 3) -> dict[str, Any]:
    """Erase a segment: operations, then a tombstone, then generations. The tombstone is one commit that
    empties the state, so readers see it whole before or empty after; the files follow."""
    ns, name = namespace_key(namespace), check_name(name)
    if confirm != name:
        raise ValidationError("confirm must repeat the segment's name")
    log = store.log
    s, gens = log.load(ns, name), store.generations(ns, name)
    warm = store.warm_path(ns, name)
    had_warm = bool(log.files.names(warm))
    if dry_run:
        return {"dropped": False, "reason": "dry-run", "generations": gens, "pending": len(s.pending)}
    log.files.delete(warm) if not s.registered else None
    if not s.registered and not gens:
        return {"dropped": had_warm, "reason": "warm-only" if had_warm else "absent", "generationsRemaining": []}
    already = s.status == "destroyed"
    log.update(ns, name, lambda now: None if now.status == "destroyed" else {"status": "destroyed", "pending": (), "current_gen": None, "gen_attempt": None, "gen_stats": None, "claims": (), "wrapped_keys": (), "lease_owner": None, "destroyed_at": log.now()})
    log.files.delete(warm)
    for _ in range(sweeps):
        for g in store.generations(ns, name):
            store.delete_generation(ns, name, g)
        if not store.generations(ns, name):
            break
    store.audit.event("dispose", namespace=ns, segment=name)
    return {"dropped": not already, "reason": "already" if already else None, "generationsRemaining": store.generations(ns, name)}


def destroy(store: SegmentStore, name: str, namespace: str | None = None, allow_cleartext: bool = False) -> dict[str, Any]:
    """Discard a segment's wrapped keys, which makes sealed chunks unreadable, and drop it. A segment without keys is
    in clear text and refused unless allowed."""
    s = store.log.load(namespace, name)
    if s.registered and s.status != "destroyed" and not s.wrapped_keys and not allow_cleartext:
        return {"destroyed": False, "reason": "cleartext"}
    out = drop(store, name, namespace, confirm=name)
    store.audit.event("erase", namespace=s.namespace, segment=name)
    return {"destroyed": True, "reason": out["reason"]}


def erase_namespace(store: SegmentStore, namespace: str, allow_cleartext: bool = False) -> list[dict[str, Any]]:
    out = []
    for ns, name in store.log.segments():
        if ns == namespace_key(namespace):
            try:
                out.append({"segment": name} | destroy(store, name, ns, allow_cleartext))
            except Exception as e:
                out.append({"segment": name, "destroyed": False, "reason": f"error: {e}"})
    store.audit.event("namespace.erase", namespace=namespace)
    return out


def _scope(namespace: str | None, all_namespaces: bool) -> str | None:
    if namespace is None and not all_namespaces:
        raise ValidationError("name a namespace or say all_namespaces=True")
    return namespace


def subject_report(store: SegmentStore, value: int, namespace: str | None = None, all_namespaces: bool = False) -> DataFrame:
    """namespace, segment of all live segments that hold the id: one job, the filter reaches every scan."""
    check_id(value, store.max_id)
    return fleet(store, _scope(namespace, all_namespaces)).where(F.col("id") == value).select("namespace", "segment").distinct()


def erase_subject(store: SegmentStore, value: int, namespace: str | None = None, all_namespaces: bool = False) -> DataFrame:
    """Remove an id everywhere and compact, so that it is gone from the files too. A ledger."""
    rows = []
    for r in subject_report(store, value, namespace, all_namespaces).collect():
        removed = False
        try:
            store.segment(r["segment"], r["namespace"]).remove(value)
            removed = True
            out = compact(store, r["segment"], r["namespace"], keep=0)
            rows.append((r["namespace"], r["segment"], True, out.compacted, out.to_gen, out.reason))
        except Exception as e:
            rows.append((r["namespace"], r["segment"], removed, False, None, f"error: {e}"))
    return store.spark.createDataFrame(rows, "namespace string, segment string, removed boolean, physically_purged boolean, to_gen long, note string")


# Checks and export


def check_consistency(store: SegmentStore, most: int = MAX_SCAN_SEGMENTS, workers: int = 16) -> dict[str, Any]:
    """Whether each current generation is there; segments without one and destroyed ones are fine. A registry of more than
    most segments is refused; use missing_generations on a listing for those."""
    rows = drain(store.registry().select("namespace", "segment", "status", "current_gen", "gen_attempt"), most)

    def one(r) -> tuple[str, tuple] | None:
        try:
            if r["status"] != "destroyed" and r["current_gen"] is not None and not store.log.files.exists(store.generation_path(r["namespace"], r["segment"], r["current_gen"], r["gen_attempt"])):
                return "inconsistent", (r["namespace"], r["segment"], r["current_gen"])
        except Exception as e:
            return "errored", (r["namespace"], r["segment"], str(e))
        return None

    with ThreadPoolExecutor(max(1, workers)) as pool:
        found = [x for x in pool.map(one, rows) if x]
    return {"checked": len(rows), "inconsistent": sorted(x for k, x in found if k == "inconsistent"), "errored": sorted(x for k, x in found if k == "errored")}


def missing_generations(registry: DataFrame, generations: DataFrame) -> DataFrame:
    """The same as a query: registry rows whose current generation isn't among (segment, gen)."""
    rows = registry.where("current_gen is not null and status <> 'destroyed'").select("segment", F.col("current_gen").alias("gen"))
    return rows.join(generations, ["segment", "gen"], "left_anti")


def drain(rows: DataFrame, most: int = MAX_SCAN_SEGMENTS) -> list:
    """All rows on the driver, or BudgetExceededError if there are more than most."""
    got = rows.limit(most + 1).collect()
    check_budget("scan", len(got), most)
    return got


def export(store: SegmentStore, target: str, form: str = "ndjson", namespace: str | None = None, most: int = MAX_SCAN_SEGMENTS) -> dict[str, Any]:
    """Every live segment to target, by namespace and segment: ndjson (an id a line; a large segment's files follow one
    another in order), parquet, or roaring (one portable file a segment, namespace=NAMESPACE/SEGMENT.roaring). The manifest counts what
    was written. A segment whose generation is missing or whose key isn't at hand is in failed, and the others are written."""
    if form not in ("ndjson", "parquet", "roaring"):
        raise ValidationError(f"not a form: {form!r}")
    keys, failed = ["namespace", "segment"], []
    lost = {(ns, name) for ns, name, _ in check_consistency(store, most)["inconsistent"]}
    failed += [{"namespace": ns, "segment": name, "error": "the current generation is missing"} for ns, name in sorted(lost) if namespace in (None, ns)]
    for r in store.registry().where("status <> 'destroyed' and size(wrapped_keys) > 0").select(*keys).collect():
        try:
            store.key(store.log.load(*r))
        except Exception as e:
            lost.add(tuple(r))
            failed.append({"namespace": r["namespace"], "segment": r["segment"], "error": str(e)})
    rows = fleet(store, namespace, without=lost)
    n = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    if form == "ndjson":
        # By ranges of ids too, so that no segment has to fit a task.
        ranged = rows.repartitionByRange(n, *keys, "id").sortWithinPartitions(*keys, "id")
        ranged.select(*keys, F.col("id").cast("string").alias("value")).write.partitionBy(*keys).text(target)
        written = store.spark.read.schema("value string, namespace string, segment string").text(target) if store.log.files.names(target) else store.empty("namespace string, segment string")
        counts = written.groupBy(*keys).agg(F.count("*").alias("ids"))
    elif form == "parquet":
        rows.write.partitionBy(*keys).parquet(target)
        counts = store.spark.read.schema("id long, namespace string, segment string").parquet(target).groupBy(*keys).agg(F.count("*").alias("ids"))
    else:
        from segspark.sources.roaring import encode_chunks, write_files

        chunks = encode_chunks(rows, *keys).repartition(n, *keys).sortWithinPartitions(*keys, "chunk_key")
        done = write_files(chunks, target, *keys)
        counts = done.select(*keys, "ids")
    got = [r.asDict() for r in counts.collect()]
    store.audit.event("export", target=target, segments=len(got))
    return {"segments": sorted(got, key=lambda r: (r["namespace"], r["segment"])), "failed": failed, "totalIds": sum(r["ids"] for r in got)}


def export_manifest(members: DataFrame) -> DataFrame:
    return members.groupBy("segment").agg(F.count("*").alias("ids"))
