"""More registered queries: the store's writes, maintenance, streams and formats over the driver's tables, each end to end
through files, with its SQL."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.catalog import HIGH, LOW, MEDIUM, NOW, UNSPEC, URGENT, WIDE, _p, _sp, _store, _sw, _t, _wide, query
from segspark.crypto import Keyring
from segspark.errors import BudgetExceededError, WriteConflictError
from segspark.functions.ids import in_domain
from segspark.lifecycle import MaintenanceLoop, run_cycle
from segspark.metrics import CountingSink
from segspark.operators import maintenance
from segspark.retry import RetryPolicy
from segspark.sources import container, interchange, roaring
from segspark.store import SegmentStore, fleet, fleet_dirty
from segspark.streaming.ingest import claim, ingest

PRIORITIES = (URGENT, HIGH, MEDIUM, UNSPEC, LOW)
DAY = maintenance.DAY_MS


def _name(priority: str) -> str:
    return priority.lower().replace(" ", "_")


_NAMED = "SELECT DISTINCT lower(replace(o_orderpriority, ' ', '_')) AS segment, o_custkey AS id FROM orders"


def _five(spark: SparkSession, d: str, namespace: str | None = None, store: SegmentStore | None = None) -> SegmentStore:
    store = store or _store(spark)
    for p in PRIORITIES:
        store.bulk_load(_name(p), _p(spark, d, p), namespace)
    return store


# Writes


@query("occ_commit", " UNION ".join(_sp(URGENT, HIGH)))
def _occ(spark: SparkSession, d: str) -> DataFrame:
    """A writer that held a state over nine commits would undo them all; it is refused."""
    store = _store(spark)
    store.bulk_load("s", _p(spark, d, URGENT))
    held = store.log.load(None, "s")
    store.segment("s").add_many(_p(spark, d, HIGH))
    for i in range(8):
        store.log.update(None, "s", lambda s, i=i: {"failures": i})
    with contextlib.suppress(WriteConflictError):
        store.log.commit(held, failures=0)
    return store.segment("s").ids()


@query("publish_generation", _sp(HIGH)[0])
def _publish(spark: SparkSession, d: str) -> DataFrame:
    """Of generations 0, 3 and 5 the newest published counts; an older one published after it doesn't."""
    store = _store(spark)
    store.bulk_load("s", _p(spark, d, URGENT))
    made = {g: store.write_generation("_default", "s", g, _p(spark, d, p)) for g, p in ((3, LOW), (5, HIGH))}
    store.publish("_default", "s", 5, made[5])
    store.publish("_default", "s", 3, made[3])
    return store.segment("s").ids()


@query("delta_domain", f"SELECT o_orderkey, o_orderkey * {WIDE * 1000} - 4000000 AS value, o_orderkey * {WIDE * 1000} - 4000000 BETWEEN 0 AND 4294967295 AS valid FROM orders")
def _domain(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("o_orderkey").cast("long") * (WIDE * 1000) - 4_000_000
    return _t(spark, d, "orders").select("o_orderkey", value.alias("value"), in_domain(value).alias("valid"))


@query("pinned_read", _sp(URGENT)[0])
def _pinned(spark: SparkSession, d: str) -> DataFrame:
    """A result asked for before a write, a compaction and a load doesn't see them."""
    store = _store(spark)
    store.bulk_load("s", _p(spark, d, URGENT))
    before = store.segment("s").ids()
    store.segment("s").add_many(_p(spark, d, HIGH))
    maintenance.compact(store, "s")
    store.segment("s").remove_many(_p(spark, d, URGENT))
    return before


@query("pending_ceiling", f"SELECT 16 * count(*) AS units, 16 * count(*) > 1000 AS refused FROM ({_sp(HIGH)[0]})")
def _ceiling(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.max_pending_bytes = 1000
    store.segment("s").add_many(_p(spark, d, HIGH))
    units, refused = 16 * sum(p["n"] for p in store.log.load(None, "s").pending), False
    try:
        store.segment("s").ids()
    except BudgetExceededError as e:
        units, refused = e.units, True
    return spark.createDataFrame([(units, refused)], "units long, refused boolean")


# Compaction and the fleet


@query("compact_bootstrap", " EXCEPT ".join(_sp(HIGH, LOW)))
def _bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """A segment that never had a generation."""
    store = _store(spark)
    store.segment("s").add_many(_p(spark, d, HIGH))
    store.segment("s").remove_many(_p(spark, d, LOW))
    maintenance.compact(store, "s")
    return store.cold(store.log.load(None, "s")).select("id")


@query("compact_purge", f"SELECT 1 AS batches, (SELECT count(*) FROM ({_sp(LOW)[0]})) AS pending_ids, count(*) AS cold_ids FROM ({' UNION '.join(_sp(URGENT, HIGH))})")
def _purge(spark: SparkSession, d: str) -> DataFrame:
    """What was folded is gone from the pending operations, what came meanwhile is kept."""
    store = _store(spark)
    store.bulk_load("s", _p(spark, d, URGENT))
    store.segment("s").add_many(_p(spark, d, HIGH))
    maintenance.compact(store, "s", step=lambda at: store.segment("s").add_many(_p(spark, d, LOW)) if at == "commit" else None)
    s = store.log.load(None, "s")
    return spark.createDataFrame([(len(s.pending), sum(p["n"] for p in s.pending), s.gen_stats["cardinality"])], "batches long, pending_ids long, cold_ids long")


_DIRTY = f"SELECT lower(replace(o_orderpriority, ' ', '_')) AS segment, count(DISTINCT (o_orderkey * {WIDE}) >> 16) AS dirty FROM orders GROUP BY 1"


def _wide_ops(spark: SparkSession, d: str) -> SegmentStore:
    store, rows = _store(spark, wide=True), _t(spark, d, "orders")
    for p in PRIORITIES:
        store.segment(_name(p)).add_many(rows.where(F.col("o_orderpriority") == p).select((F.col("o_orderkey").cast("long") * WIDE).alias("id")))
    return store


@query("fleet_dirty", _DIRTY)
def _fleet_dirty(spark: SparkSession, d: str) -> DataFrame:
    return fleet_dirty(_wide_ops(spark, d)).select("segment", "dirty")


@query("compaction_cycle", f"SELECT segment FROM ({_DIRTY}) ORDER BY dirty DESC, segment LIMIT 3")
def _cycle(spark: SparkSession, d: str) -> DataFrame:
    store = _wide_ops(spark, d)
    maintenance.run_compaction_cycle(store, max_segments=3, min_dirty=2)
    return store.registry().where("current_gen is not null and size(pending) = 0").select("segment")


@query("drop_segment", f"SELECT segment, count(*) AS n FROM ({_NAMED}) WHERE segment <> '{_name(HIGH)}' GROUP BY 1")
def _drop(spark: SparkSession, d: str) -> DataFrame:
    store = _five(spark, d)
    maintenance.drop(store, _name(HIGH), confirm=_name(HIGH))
    return fleet(store).groupBy("segment").agg(F.count("*").alias("n"))


@query("erase_namespace", f"SELECT 'kept' AS namespace, segment, count(*) AS n FROM ({_NAMED}) GROUP BY 2")
def _erase_ns(spark: SparkSession, d: str) -> DataFrame:
    store = _five(spark, d, "gone", _five(spark, d, "kept"))
    maintenance.erase_namespace(store, "gone", allow_cleartext=True)
    return fleet(store).groupBy("namespace", "segment").agg(F.count("*").alias("n"))


@query("registry_scan", "SELECT DISTINCT lower(replace(o_orderpriority, ' ', '_')) AS segment, 'active' AS status, 0::BIGINT AS generation FROM orders")
def _registry(spark: SparkSession, d: str) -> DataFrame:
    rows = maintenance.drain(_five(spark, d).registry().select("segment", "status", "current_gen"), 5)
    return spark.createDataFrame([tuple(r) for r in rows], "segment string, status string, generation long")


@query("due_index_sweep", "SELECT 'n' || n_nationkey AS segment, CASE WHEN n_nationkey BETWEEN 5 AND 12 THEN 'retired' ELSE 'active' END AS state FROM nation")
def _sweep(spark: SparkSession, d: str) -> DataFrame:
    """A segment for each nation, due from twelve days ago on; the index looks back on seven."""
    store = _store(spark)
    for r in _t(spark, d, "nation").select("n_nationkey").toLocalIterator():
        store.log.update(None, f"n{r[0]}", lambda s: {"failures": 0})
        maintenance.set_retention(store, f"n{r[0]}", NOW + (r[0] - 12) * DAY)
    maintenance.retire_expired(store, scan=False)
    return store.registry().select("segment", F.when(F.col("status") == "destroyed", "retired").otherwise("active").alias("state"))


@query("lifecycle_cycle", f"SELECT segment, count(*) AS n, 0::BIGINT AS pending FROM ({_NAMED}) WHERE segment NOT IN ('{_name(URGENT)}', '{_name(LOW)}') GROUP BY 1")
def _lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """One cycle drops the two segments that are due and compacts the others."""
    store = _store(spark)
    for p in PRIORITIES:
        store.segment(_name(p)).add_many(_p(spark, d, p))
    for p in (URGENT, LOW):
        maintenance.set_retention(store, _name(p), NOW)
    run_cycle(store)
    pending = store.registry().select("segment", F.size("pending").cast("long").alias("pending"))
    return fleet(store).groupBy("segment").agg(F.count("*").alias("n")).join(pending, "segment")


@query("loop_delays", "SELECT i AS failures, least(900.0, 60.0 * pow(2, i))::DOUBLE AS delay FROM range(7) r(i)")
def _delays(spark: SparkSession, d: str) -> DataFrame:
    loop, rows = MaintenanceLoop(lambda: 1 // 0, 60, 900, 0), []
    for i in range(7):
        rows.append((i, float(loop.delay())))
        loop.once()
    return spark.createDataFrame(rows, "failures long, delay double")


@query("retry_delays", "SELECT i AS attempt, least(2.0, 0.05 * pow(2, i))::DOUBLE AS most FROM range(8) r(i)")
def _retries(spark: SparkSession, d: str) -> DataFrame:
    class Whole:
        def random(self) -> float:
            return 1.0

    return spark.createDataFrame([(i, RetryPolicy().delay(i, Whole())) for i in range(8)], "attempt long, most double")


@query("metrics_and_audit", "SELECT * FROM (VALUES ('add_many', 1), ('claim_many', 1), ('compact', 1), ('dispose', 1), ('union_into', 1)) v(kind, n)")
def _events(spark: SparkSession, d: str) -> DataFrame:
    metrics, audit = CountingSink(), CountingSink()
    store = SegmentStore(spark, _store(spark).root, clock=lambda: NOW / 1000, metrics=metrics, audit=audit)
    store.segment("a").claim_many(_p(spark, d, LOW))
    store.segment("a").union_into(store.segment("b"))
    maintenance.compact(store, "a")
    maintenance.drop(store, "a", confirm="a")
    counts = {k: metrics.counts[k] for k in ("claim_many", "union_into", "add_many")} | {k: audit.counts[k] for k in ("compact", "dispose")}
    return spark.createDataFrame(sorted(counts.items()), "kind string, n int")


@query("command_compact", f"SELECT count(*) AS n, 0::BIGINT AS generation FROM ({_sp(MEDIUM)[0]})")
def _command(spark: SparkSession, d: str) -> DataFrame:
    from segspark.__main__ import main

    store = _store(spark)
    store.segment("s").add_many(_p(spark, d, MEDIUM))
    with contextlib.redirect_stdout(io.StringIO()):
        main(["compact", "--root", store.root], spark)
    s = store.log.load(None, "s")
    return store.cold(s).agg(F.count("*").alias("n")).withColumn("generation", F.lit(s.current_gen).cast("long"))


# Formats and streams


@query("export_ndjson", _NAMED)
def _ndjson(spark: SparkSession, d: str) -> DataFrame:
    store = _five(spark, d)
    maintenance.export(store, f"{store.root}-out")
    return spark.read.text(f"{store.root}-out").select("segment", F.col("value").cast("long").alias("id"))


@query("export_roaring", _NAMED)
def _roaring_files(spark: SparkSession, d: str) -> DataFrame:
    """One portable bitmap a segment, read back file by file."""
    store = _five(spark, d)
    maintenance.export(store, f"{store.root}-out", "roaring")
    return roaring.read_files(spark, f"{store.root}-out").select("segment", "id")


@query("container_round_trip", _sw())
def _container(spark: SparkSession, d: str) -> DataFrame:
    """Container files of 64 Ki chunks each, written beside the store and read with all their checksums."""
    store = _store(spark)
    container.write_files(_wide(spark, d), f"{store.root}-files")
    return container.read_files(spark, f"{store.root}-files").select("id")


@query("lines_round_trip", _sw())
def _lines(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_store(spark).root}-lines"
    interchange.write_lines(_wide(spark, d), path)
    return interchange.read_lines(spark, path, wide=True)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema("o_custkey long, o_orderpriority string").option("pathGlobFilter", "orders.parquet").parquet(d).select(F.col("o_custkey").alias("id"), "o_orderpriority")


def _drained(stream: DataFrame, store: SegmentStore, name: str, f) -> None:
    stream.writeStream.foreachBatch(f).option("checkpointLocation", f"{store.root}-cp/{name}").trigger(availableNow=True).start().awaitTermination()


@query("stream_ingest", " UNION ".join(_sp(HIGH, LOW)))
def _stream(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.bulk_load("s", _p(spark, d, HIGH))
    _drained(_orders(spark, d).where(F.col("o_orderpriority") == LOW), store, "in", ingest(store, "q", "s"))
    return store.segment("s").ids()


@query("stream_claim", "({}) EXCEPT ({})".format(*_sp(LOW, HIGH)))
def _stream_claim(spark: SparkSession, d: str) -> DataFrame:
    """The sink fails once; the stream's repeat of the batch hands it the same winners."""
    store, failed = _store(spark), []
    store.bulk_load("s", _p(spark, d, HIGH))
    out = f"{store.root}-won"

    def sink(won: DataFrame, number: int) -> None:
        if not failed:
            failed.append(number)
            raise RuntimeError("the sink is down")
        won.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for _ in range(2):
        with contextlib.suppress(Exception):
            _drained(_orders(spark, d).where(F.col("o_orderpriority") == LOW), store, "claims", claim(store, "q", "s", sink))
    return spark.read.schema("id long").parquet(out).select("id")


@query("sealed_store", f"SELECT chunk_key, sum(id)::BIGINT AS total FROM (SELECT (id >> 16)::INT AS chunk_key, id FROM (({_sw('F')}) UNION ({_sw('O')}))) GROUP BY 1")
def _sealed_store(spark: SparkSession, d: str) -> DataFrame:
    """A store with a keyring: a load, pending operations and a compaction, all of them sealed on disk."""
    ring = Keyring(spark, {"main": b"m" * 32})
    store = SegmentStore(spark, _store(spark).root, clock=lambda: NOW / 1000, keyring=ring, wide=True)
    store.bulk_load("s", _wide(spark, d, "F"))
    store.segment("s").add_many(_wide(spark, d, "O"))
    maintenance.compact(store, "s")
    return store.segment("s").ids().groupBy(F.shiftright("id", 16).cast("int").alias("chunk_key")).agg(F.sum("id").alias("total"))


