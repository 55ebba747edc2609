from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from segspark.errors import BudgetExceededError, IntegrityError, ValidationError, WriteConflictError
from segspark.metrics import CountingSink, RecordingSink
from segspark.operators import maintenance as m
from segspark.sources.log import State
from segspark.store import SegmentStore
from tests.conftest import ids

NOW = 1_000_000_000_000 + 700 * m.DAY_MS


class Clock:
    def __init__(self):
        self.ms = NOW

    def __call__(self):
        return self.ms / 1000


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    return SegmentStore(spark, f"file://{tmp_path}/store", clock=clock)


def test_bulk_load_and_operations(store):
    got = store.bulk_load("s", [9, 3, 3, 9, 1, 2, 2, 1, 70000, 70000])
    assert (got["cardinality"], got["chunk_count"], got["generation"], got["current"]) == (5, 2, 0, True)
    s = store.segment("s")
    s.add_many([3, 5, 65535, 65536])
    s.remove_many([9, 123])
    s.add(9)
    s.remove(1)
    assert ids(s.ids()) == [2, 3, 5, 9, 65535, 65536, 70000]
    assert s.count() == 7
    assert [s.has(x) for x in (9, 1, 70000, 4, 2)] == [True, False, True, False, True]
    assert [r["id"] for r in s.iterate().collect()] == [2, 3, 5, 9, 65535, 65536, 70000]


def test_wrong_ids_and_names(store):
    for bad in ([-1], [1 << 32]):
        with pytest.raises(ValidationError):
            store.segment("s").add_many(bad)
    with pytest.raises(ValidationError):
        store.segment("../s")
    with pytest.raises(ValidationError):
        store.segment("s", expires_at=123)


def test_claims(store):
    s = store.segment("c")
    assert ids(s.claim_many([1, 2, 3])) == [1, 2, 3]
    assert ids(s.claim_many([1, 2, 3])) == []
    assert ids(s.claim_many([2, 3, 4, 4])) == [4]
    s.remove(2)
    assert ids(s.claim_many([1, 2, 65535, 65536])) == [2, 65535, 65536]
    assert m.compact(store, "c").compacted
    assert ids(s.claim_many([1, 7])) == [7]


def test_claim_recomputes_after_a_lost_race(store, monkeypatch):
    s = store.segment("c")
    real, raced = store.log.commit, []

    def commit(was, **changes):
        if not raced:
            raced.append(1)
            store.segment("c").add_many([1])  # another writer, between reading and committing
        return real(was, **changes)

    monkeypatch.setattr(store.log, "commit", commit)
    assert ids(s.claim_many([1, 2])) == [2]


def test_algebra_with_expiry_and_exclude(store, clock):
    for name, v in (("a", [1, 2, 3, 4]), ("b", [2, 3, 4, 5]), ("x", [3])):
        store.bulk_load(name, v)
    a, b, x = (store.segment(n) for n in "abx")
    old = store.segment("b", expires_at=NOW)
    assert ids(a.intersect([b], [x])) == [2, 4]
    assert ids(a.intersect([old])) == [] and ids(a.union([old], [x])) == [1, 2, 4]
    assert old.count() == 0 and not old.has(2) and ids(old.ids()) == []
    assert ids(a.and_not([x])) == [1, 2, 4]
    assert ids(a.and_not([store.segment("x", expires_at=NOW)])) == [1, 2, 3, 4]
    assert a.intersect_efficiency([b]) == {"fetched": 1, "skipped": 0}
    dest = store.segment("d")
    dest.add(100)
    a.intersect_into(dest, [b], [x])
    assert ids(dest.ids()) == [2, 4, 100]
    with pytest.raises(BudgetExceededError):
        a.intersect([b], budget=1)
    assert ids(a.intersect([b], budget=False)) == [2, 3, 4]


def test_compaction_decisions(store, clock):
    assert m.compact(store, "none").reason == "clean"
    s = store.segment("s")
    s.add_many([1, 2, 3])
    out = m.compact(store, "s")
    assert (out.compacted, out.from_gen, out.to_gen, out.purged) == (True, None, 0, 1)
    assert m.compact(store, "s").reason == "clean"
    s.remove_many([1, 2, 3])
    out = m.compact(store, "s")
    assert (out.to_gen, s.count(), ids(s.ids())) == (1, 0, [])
    s.add(5)
    store.log.update(None, "s", lambda _: {"lease_owner": "w", "lease_expires_at": clock.ms + 1})
    assert m.compact(store, "s").reason == "leased-by-other"
    clock.ms += 2
    assert m.compact(store, "s").compacted
    m.drop(store, "s", confirm="s")
    assert m.compact(store, "s").reason == "destroyed"


def test_write_after_the_pin_survives(store):
    s = store.segment("s")
    s.add_many([1, 2])

    def step(at):
        if at == "commit":
            s.add(3)
            s.remove(1)

    out = m.compact(store, "s", step=step)
    assert out.compacted and out.survived == 2
    assert ids(s.ids()) == [2, 3]


@pytest.mark.parametrize("at", ["lease", "stage", "verify", "commit", "purge"])
def test_crash_during_compaction_changes_no_answer(store, clock, at):
    store.bulk_load("s", [1, 2, 3])
    s = store.segment("s")
    s.add_many([4, 5])
    s.remove(1)

    def crash(now):
        if now == at:
            raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        m.compact(store, "s", step=crash)
    assert ids(s.ids()) == [2, 3, 4, 5] and s.count() == 4
    clock.ms += m.LEASE_MS + 1
    m.compact(store, "s")
    assert ids(s.ids()) == [2, 3, 4, 5] and s.count() == 4
    assert m.check_consistency(store) == {"checked": 1, "inconsistent": [], "errored": []}


def test_damage_is_found(store):
    store.bulk_load("s", [1, 2, 70000])
    assert store.verify_generation("_default", "s", 0)
    store.delete_generation("_default", "s", 0)
    assert m.check_consistency(store)["inconsistent"] == [("_default", "s", 0)]
    with pytest.raises(IntegrityError):
        State.from_json(b'{"schema": 1}')


def test_collecting_generations(store):
    for i in range(4):
        store.bulk_load("s", [i])
    assert store.generations("_default", "s") == [0, 1, 2, 3]
    assert m.collect_generations(store, "s", keep=1) == [0, 1]
    assert store.publish("_default", "s", 2) is False and ids(store.segment("s").ids()) == [3]


def test_commits_are_exclusive(store):
    s = store.log.commit(State("_default", "s"))
    store.log.commit(s, failures=1)
    with pytest.raises(WriteConflictError):
        store.log.commit(s, failures=2)
    assert store.log.load(None, "s").failures == 1


def test_a_state_held_for_long_is_refused(store, monkeypatch):
    """Its successor's name was trimmed meanwhile, so the create itself would go through."""
    from segspark.sources import log

    monkeypatch.setattr(log, "KEPT_MS", 0)
    held = store.log.update(None, "s", lambda s: {"failures": 0})
    for i in range(12):
        store.log.update(None, "s", lambda s, i=i: {"failures": i + 1})
    before = store.log.files.names(store.log.files.path("log", "_default", "s"))
    with pytest.raises(WriteConflictError):
        store.log.commit(held, failures=99)
    store.log.files.create(store.log._file(store.log._folder("_default", "s"), held.version), held.to_json())  # as if it hadn't been trimmed yet
    with pytest.raises(WriteConflictError):
        store.log.commit(held, failures=99)
    store.log.files.delete(store.log._file(store.log._folder("_default", "s"), held.version))
    assert store.log.files.names(store.log.files.path("log", "_default", "s")) == before
    assert store.log.load(None, "s").failures == 12 and len(before) <= 4


def test_a_scan_of_the_registry_stands_writers(store):
    for name in "ab":
        store.segment(name).add(1)
    scan = store.registry().select("segment", "next_seq")
    for _ in range(10):
        store.log.update(None, "a", lambda s: {"failures": s.failures + 1})
    assert {tuple(r) for r in scan.collect()} == {("a", 1), ("b", 1)}
    for _ in range(70):
        store.log.update(None, "b", lambda s: {"failures": s.failures + 1})
    assert len(store.log._versions(store.log._folder("_default", "b"))) <= 64


def test_a_commit_that_others_followed_at_once_holds(store, monkeypatch):
    """Many commits between a writer's create and its look at the log."""
    from segspark.sources import log

    monkeypatch.setattr(log, "KEPT_MS", 0)
    was, real, once = store.log.update(None, "s", lambda s: {"failures": 1}), store.log.files.create, []

    def create(p, data):
        real(p, data)
        if not once:
            once.append(1)
            for i in range(10):
                store.log.update(None, "s", lambda s, i=i: {"failures": 10 + i})

    monkeypatch.setattr(store.log.files, "create", create)
    mine = store.log.commit(was, failures=5)
    assert mine.history[-1] in store.log.load(None, "s").history and store.log.load(None, "s").failures == 19


def test_a_slow_claim_has_no_second_winner(store, monkeypatch):
    s, real, slow = store.segment("c"), store.log.commit, []

    def commit(was, **changes):
        monkeypatch.setattr("segspark.sources.log.KEPT_MS", 0)
        if not slow:  # the first caller's job takes long: another claims the same ids, and much is written after that
            slow.append(1)
            slow.append(ids(store.segment("c").claim_many([5, 6])))
            for i in range(10):
                store.segment("c").add_many([100 + i])
        return real(was, **changes)

    s.add(1)
    monkeypatch.setattr(store.log, "commit", commit)
    assert ids(s.claim_many([5, 6, 7])) == [7] and slow[1] == [5, 6]


def test_half_written_states_are_read_again(store, monkeypatch):
    store.log.update(None, "s", lambda s: {"failures": 3})
    real, cut = store.log.files.read, []

    def read(p):
        data = real(p)
        if len(cut) < 2:
            cut.append(1)
            return data[: len(data) // 2]
        return data

    monkeypatch.setattr(store.log.files, "read", read)
    assert store.log.load(None, "s").failures == 3
    monkeypatch.setattr(store.log.files, "read", lambda p: b"{")
    with pytest.raises(IntegrityError):
        store.log.load(None, "s")


def test_forgotten_logs_refuse_their_old_writers(store):
    store.segment("s").add(1)
    held = store.log.load(None, "s")
    m.drop(store, "s", confirm="s")
    gone = store.log.load(None, "s")
    assert not store.log.forget(held) and store.log.forget(gone)
    with pytest.raises(WriteConflictError):
        store.log.commit(held, failures=1)
    assert not store.log.load(None, "s").registered


def test_exclusive_creates_by_file_system(spark, tmp_path):
    from segspark.errors import UnsupportedError
    from segspark.sources.fs import CONDITIONAL, RIGHTS, Files, way_to_create

    able = lambda *have: lambda c: c in have
    assert [way_to_create("file", able()), way_to_create("hdfs", able()), way_to_create("abfss", able(RIGHTS)), way_to_create("s3a", able(CONDITIONAL))] == ["link", "rename", "rename", "conditional"]
    for scheme in ("s3a", "abfss", "gs", "ftp"):
        with pytest.raises(UnsupportedError):
            way_to_create(scheme, able())
    for way in ("link", "rename"):  # the rename through Hadoop's local file system
        files = Files(spark, f"file://{tmp_path}/{way}")
        files._way = way
        files.create(files.path("a", "x.json"), b"one")
        with pytest.raises(WriteConflictError):
            files.create(files.path("a", "x.json"), b"two")
        assert files.read(files.path("a", "x.json")) == b"one" and [n for n in files.names(files.path("a")) if not n.endswith(".crc")] == ["x.json"]


def test_passing_faults_are_tried_again(spark, tmp_path):
    from segspark.errors import TransientError
    from segspark.sources.fs import Files

    files, calls = Files(spark, f"file://{tmp_path}/f"), []

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise TransientError("busy")
        return 7

    assert files._try(run) == 7 and len(calls) == 3
    with pytest.raises(Exception, match="FileNotFound"):
        files.read(files.path("nothing"))


def test_a_worker_that_outlives_its_lease_harms_nobody(store, clock):
    """A second worker compacts while the first is still writing: both write apart, one is published."""
    store.bulk_load("s", [1, 2, 3])
    s = store.segment("s")
    s.add_many([4])
    second = []

    def step(at):
        if at == "verify" and not second:
            second.append(1)
            clock.ms += m.LEASE_MS + 1
            second.append(m.compact(store, "s", owner="two"))
            s.add(5)

    first = m.compact(store, "s", owner="one", step=step)
    assert second[1].compacted and not first.compacted and first.reason == "superseded"
    assert ids(s.ids()) == [1, 2, 3, 4, 5] and s.count() == 5
    assert store.verify_generation("_default", "s", 1)
    assert m.check_consistency(store)["inconsistent"] == []


def test_leases_are_renewed(store, clock):
    s = store.segment("s")
    s.add(1)
    seen = []

    def step(at):
        if at == "verify":
            clock.ms += m.LEASE_MS - 1000
            time.sleep(0.5)
            clock.ms += 2000
            seen.append(m.compact(store, "s", owner="other").reason)

    assert m.compact(store, "s", owner="one", renew_s=0.05, step=step).compacted
    assert seen == ["leased-by-other"]


def test_two_loads_at_once(store, monkeypatch):
    real, other = store.publish, []

    def publish(ns, name, gen, stats=None):
        if not other:
            other.append(1)
            store.bulk_load("s", [7])
        return real(ns, name, gen, stats)

    monkeypatch.setattr(store, "publish", publish)
    assert store.bulk_load("s", [1, 2])["current"]
    assert ids(store.segment("s").ids()) == [1, 2]


def test_a_failed_sink_gets_its_winners_again(store):
    from segspark.streaming.ingest import claim

    spark, got = store.spark, []

    def sink(df, n):
        got.append(ids(df))
        if len(got) == 1:
            raise RuntimeError("sink")

    run = claim(store, "q", "s", sink)
    batch = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    with pytest.raises(RuntimeError):
        run(batch, 0)
    m.compact(store, "s")  # the claim's batch is folded meanwhile
    run(batch, 0)
    run(batch, 0)  # done by now
    run(spark.createDataFrame([(2,), (3,)], "id long"), 1)
    assert got == [[1, 2], [1, 2], [3]]
    assert len(store.log.load(None, "s").claims) == 1


def test_retention(store, clock):
    past, future = NOW - m.DAY_MS, NOW + m.DAY_MS
    for name, at in (("old", past), ("due", NOW), ("new", future)):
        store.segment(name).add(1)
        m.set_retention(store, name, at)
    store.segment("free").add(1)
    store.log.update(None, "free", lambda _: {"retention": {"expiresAt": 5}})
    assert m.get_retention(store, "free")[0] == "invalid" and m.get_retention(store, "nothing") == ("none", None)
    dry = m.retire_expired(store, dry_run=True)
    assert {(r["segment"], r["action"]) for r in dry["ledger"].collect()} == {("old", "would-retire"), ("due", "would-retire"), ("free", "skipped")}
    one = m.retire_expired(store, limit=1)
    assert one["limited"] and {r["segment"] for r in one["ledger"].collect() if r["action"] == "retired"} == {"old"}
    m.retire_expired(store)
    assert [store.segment(n).count() for n in ("old", "due", "new", "free")] == [0, 0, 1, 1]
    clock.ms += m.TOMBSTONE_GRACE_MS
    m.clear_retention(store, "new")
    assert {r["segment"] for r in m.retire_expired(store)["ledger"].collect() if r["action"] == "forgot"} == {"old", "due"}
    with pytest.raises(ValidationError):
        m.set_retention(store, "x", 123)


def test_sweeps_by_the_due_index(store, clock, monkeypatch):
    for name, at in (("a", NOW - 2 * m.DAY_MS), ("b", NOW - m.DAY_MS), ("later", NOW + 2 * m.DAY_MS), ("moved", NOW - m.DAY_MS), ("old", NOW - 30 * m.DAY_MS)):
        store.segment(name).add(1)
        m.set_retention(store, name, at)
    m.set_retention(store, "moved", NOW + 5 * m.DAY_MS)
    assert {x[2] for x in m.due_marks(store, NOW)} == {"a", "b", "moved"}
    monkeypatch.setattr(type(store), "registry", lambda _: (_ for _ in ()).throw(AssertionError("the fleet isn't asked")))
    one = m.retire_expired(store, limit=1, scan=False)
    assert one["limited"] and [r["segment"] for r in one["ledger"].collect()] == ["a"]
    assert {r["segment"] for r in m.retire_expired(store, scan=False)["ledger"].collect()} == {"b"}
    assert m.due_marks(store, NOW) == [] and store.segment("moved").count() == 1
    monkeypatch.undo()
    # Beyond the days looked back on, a scan finds it.
    assert {r["segment"] for r in m.retire_expired(store)["ledger"].collect() if r["action"] == "retired"} == {"old"}
    clock.ms += 2 * m.DAY_MS
    assert {r["segment"] for r in m.retire_expired(store, scan=False)["ledger"].collect()} == {"later"}


def test_cycles_are_leased_and_scan_at_times(store, clock):
    from segspark.lifecycle import run_cycle

    store.segment("s").add(1)
    first = run_cycle(store, cycle_ms=1000, repair_every=3)
    assert (first["cycle"], first["scan"]) == (1, True) and [o.segment for o in first["compaction"]] == ["s"]
    assert run_cycle(store, cycle_ms=1000, repair_every=3)["skipped"] == "leased-by-other"
    scans = []
    for _ in range(3):
        clock.ms += 1000
        out = run_cycle(store, cycle_ms=1000, repair_every=3)
        scans.append((out["cycle"], out["scan"]))
    assert scans == [(2, False), (3, True), (4, False)]


def test_drop_and_destroy(store):
    assert m.drop(store, "none", confirm="none")["reason"] == "absent"
    store.bulk_load("s", [1, 2])
    with pytest.raises(ValidationError):
        m.drop(store, "s", confirm="t")
    assert m.drop(store, "s", confirm="s", dry_run=True)["generations"] == [0]
    assert m.destroy(store, "s")["reason"] == "cleartext" and store.segment("s").count() == 2
    assert m.drop(store, "s", confirm="s")["generationsRemaining"] == []
    assert ids(store.segment("s").ids()) == [] and not store.segment("s").has(1)
    assert m.drop(store, "s", confirm="s")["reason"] == "already"
    store.segment("s").add(7)  # writing makes it anew
    assert ids(store.segment("s").ids()) == [7]


def test_subjects(store):
    for ns, name, v in ((None, "a", [1, 2]), ("n", "b", [2, 3]), ("n", "c", [3])):
        store.bulk_load(name, v, ns)
    store.segment("c", "n").add(2)
    with pytest.raises(ValidationError):
        m.subject_report(store, 2)
    assert {tuple(r) for r in m.subject_report(store, 2, all_namespaces=True).collect()} == {("_default", "a"), ("n", "b"), ("n", "c")}
    ledger = m.erase_subject(store, 2, "n").collect()
    assert {(r["segment"], r["removed"], r["physically_purged"]) for r in ledger} == {("b", True, True), ("c", True, True)}
    assert {tuple(r) for r in m.subject_report(store, 2, all_namespaces=True).collect()} == {("_default", "a")}


def test_cycle_isolates_failures(store, monkeypatch):
    for name in "abc":
        store.segment(name).add(1)
    store.segment("a").add(2)
    real = m.compact

    def compact(st, name, ns=None, **k):
        if name == "b":
            raise RuntimeError("no")
        return real(st, name, ns, **k)

    monkeypatch.setattr(m, "compact", compact)
    out = {o.segment: o for o in m.run_compaction_cycle(store)}
    assert out["a"].compacted and out["c"].compacted and out["b"].reason == "error: no"
    assert store.log.load(None, "b").failures == 1


def test_export_and_registry(store, tmp_path):
    store.bulk_load("a", [3, 1, 70000])
    store.bulk_load("b", [2], "n")
    store.segment("gone").add(1)
    m.drop(store, "gone", confirm="gone")
    out = m.export(store, f"file://{tmp_path}/nd")
    assert out["totalIds"] == 4 and [(r["segment"], r["ids"]) for r in out["segments"]] == [("a", 3), ("b", 1)]
    back = store.spark.read.text(f"file://{tmp_path}/nd").where("segment = 'a'")
    assert sorted(int(r["value"]) for r in back.collect()) == [1, 3, 70000]
    from segspark.sources.roaring import decode

    store.bulk_load("r", [*range(1000), *range(65536, 75536, 2), 1 << 31])
    made = m.export(store, f"file://{tmp_path}/ro", "roaring")
    assert made["totalIds"] == 4 + 6001 and made["failed"] == []
    assert decode((tmp_path / "ro/namespace=_default/a.roaring").read_bytes()).tolist() == [1, 3, 70000] and decode((tmp_path / "ro/namespace=n/b.roaring").read_bytes()).tolist() == [2]
    assert decode((tmp_path / "ro/namespace=_default/r.roaring").read_bytes()).tolist() == [*range(1000), *range(65536, 75536, 2), 1 << 31]
    store.log.files.delete(store.generation_path("_default", "r", 0))
    for form in ("parquet", "ndjson", "roaring"):
        part = m.export(store, f"file://{tmp_path}/part-{form}", form)
        assert [x["segment"] for x in part["failed"]] == ["r"] and part["totalIds"] == 4
    m.drop(store, "r", confirm="r")
    store.log.forget(store.log.load(None, "r"))
    assert len(m.drain(store.registry(), 3)) == 3
    with pytest.raises(BudgetExceededError):
        m.drain(store.registry(), 2)
    assert {(r["segment"], r["status"]) for r in store.registry().collect()} == {("a", "active"), ("b", "active"), ("gone", "destroyed")}


def test_container_files_are_readable(spark, tmp_path):
    import numpy as np

    from segspark.sources import container

    (tmp_path / "g0").write_bytes(container.write(np.array([5, 70000])))
    (tmp_path / "g1").write_bytes(container.write(np.array([6])))
    assert ids(container.read_files(spark, f"file://{tmp_path}")) == [5, 6, 70000]


def test_random_operations_against_a_set(store):
    rng, want = random.Random(3), set()
    cold = [rng.randrange(300_000) for _ in range(50)]
    store.bulk_load("s", cold)
    want |= set(cold)
    s = store.segment("s")
    for i in range(6):
        batch = rng.sample(range(300_000), 15) + rng.sample(sorted(want), min(5, len(want)))
        if rng.random() < 0.5:
            s.add_many(batch)
            want |= set(batch)
        else:
            s.remove_many(batch)
            want -= set(batch)
        if i == 3:
            m.compact(store, "s")
    assert ids(s.ids()) == sorted(want) and s.count() == len(want)


def test_sinks_never_fail_a_call(spark, tmp_path):
    class Broken:
        def event(self, kind, fields):
            raise RuntimeError

    counting, audit = CountingSink(), RecordingSink()
    store = SegmentStore(spark, f"file://{tmp_path}/s", metrics=counting, audit=audit)
    store.segment("a").claim_many([1])
    store.segment("a").union_into(store.segment("b"))
    assert counting.counts["claim_many"] == 1 and counting.counts["union_into"] == 1
    m.drop(store, "a", confirm="a")
    assert [k for k, _ in audit.events] == ["dispose"]
    SegmentStore(spark, f"file://{tmp_path}/t", metrics=Broken()).segment("a").add(1)


def test_encryption(spark):
    from segspark.crypto import Keyring, seal, unseal
    from segspark.errors import KeyUnavailableError

    ring = Keyring(spark, {"main": b"m" * 32, "recovery": b"r" * 32})
    key, copies = ring.new_key()
    assert Keyring(spark, {"recovery": b"r" * 32}).unwrap(copies) == key
    with pytest.raises(KeyUnavailableError):
        Keyring(spark, {"other": b"o" * 32}).unwrap(copies)
    chunks = spark.createDataFrame([(0, 1, bytearray(b"abc"))], "generation long, chunk_key int, payload binary")
    sealed = seal(chunks, key, "n", "s")
    assert len(sealed.first()["sealed"]) == 12 + 3 + 16
    assert bytes(unseal(sealed, key, "n", "s").first()["payload"]) == b"abc"
    for df, ns in ((sealed, "other"), (sealed.withColumn("generation", F.col("generation") + 1), "n")):
        with pytest.raises(Exception, match="doesn't open"):
            unseal(df, key, ns, "s").collect()


def test_sealed_store(spark, tmp_path):
    from segspark.crypto import Keyring
    from segspark.errors import KeyUnavailableError
    from segspark.sources.roaring import encode_chunks

    root, ring = f"file://{tmp_path}/s", Keyring(spark, {"main": b"m" * 32, "spare": b"r" * 32})
    store = SegmentStore(spark, root, keyring=ring)
    store.bulk_load("s", [1, 2, 70000])
    s = store.segment("s")
    s.add_many([3, 140001])
    s.remove(1)
    assert ids(s.claim_many([3, 4])) == [4]
    assert ids(s.ids()) == [2, 3, 4, 70000, 140001] and s.count() == 5 and s.has(3) and not s.has(1)
    assert m.compact(store, "s").compacted and store.cold(s.state()).count() == 5
    assert ids(s.ids()) == [2, 3, 4, 70000, 140001] and s.has(70000)
    plain = [bytes(r["bitmap"]) for r in encode_chunks(s.ids()).collect()]
    files = b"".join(f.read_bytes() for f in tmp_path.rglob("*.parquet"))
    assert all(len(p) < 20 or p not in files for p in plain)
    with pytest.raises(KeyUnavailableError):
        SegmentStore(spark, root).segment("s").ids()
    spare = SegmentStore(spark, root, keyring=Keyring(spark, {"spare": b"r" * 32}))
    assert spare.segment("s").count() == 5
    assert m.destroy(store, "s") == {"destroyed": True, "reason": None}
    assert store.log.load(None, "s").wrapped_keys == () and s.count() == 0


def test_cli(spark, tmp_path, capsys):
    from segspark.__main__ import main

    root = f"file://{tmp_path}/s"
    SegmentStore(spark, root).segment("a").add_many([1, 2])
    assert main(["compact", "--root", root], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"compacted": 1, "skipped": {}}
    assert main(["check", "--root", root], spark) == 0
    assert main(["export", "--root", root, "--target", f"{root}-out"], spark) == 0
    assert main(["export", "--root", root], spark) == 2


def test_loop_backs_off():
    from segspark.lifecycle import MaintenanceLoop

    fail = [True, True, False]

    def cycle():
        if fail.pop(0):
            raise RuntimeError("x")

    loop = MaintenanceLoop(cycle, 10, 30, 0)
    assert not loop.once() and loop.delay() == 20
    assert not loop.once() and loop.delay() == 30 and not loop.healthy()
    assert loop.once() and loop.healthy() and loop.delay() == 10


def test_streams(spark, store, tmp_path):
    from segspark.streaming.ingest import claim, day_buckets, ingest, trailing_active

    src = tmp_path / "in"
    spark.createDataFrame([(i,) for i in (1, 2, 2, 70000)], "id long").write.parquet(str(src))
    stream = spark.readStream.schema("id long").parquet(str(src))

    def run(f):
        stream.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / f"cp{random.random()}")).trigger(availableNow=True).start().awaitTermination()

    run(ingest(store, "q", "s"))
    assert ids(store.segment("s").ids()) == [1, 2, 70000]
    run(ingest(store, "q", "s"))  # the same batch number again: done already
    assert len(store.log.load(None, "s").pending) == 1
    won = []
    run(claim(store, "c", "k", lambda df, n: won.extend(ids(df))))
    run(claim(store, "d", "k", lambda df, n: won.extend(ids(df))))
    assert sorted(won) == [1, 2, 70000]
    ev = spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 1), ("2024-01-05", 1), ("2024-01-09", 2)], "ts string, user_id long")
    got = {str(r["day"]): r["n_active"] for r in trailing_active(day_buckets(ev)).collect()}
    assert got == {"2024-01-01": 1, "2024-01-05": 1, "2024-01-09": 2}


def test_cycle_counts_dirty_chunks(store):
    store.segment("wide").add_many([i << 16 for i in range(5)])
    for _ in range(3):
        store.segment("narrow").add(1)
    assert [o.segment for o in m.run_compaction_cycle(store, max_segments=1, min_dirty=2)] == ["wide"]
    assert m.run_compaction_cycle(store, min_dirty=2) == []
    assert [o.segment for o in m.run_compaction_cycle(store)] == ["narrow"]
