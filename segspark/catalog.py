"""The registered queries of the segment engine over the driver's tables, each with its SQL for DuckDB.

Segments are derived from the tables: P(priority) of customers by order priority, L(flag) of orders by return flag
and line status, W of orders with ids spread over many chunks, D of users by day.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.errors import ValidationError
from segspark.functions import bitmaps
from segspark.functions.cost import fleet_cost
from segspark.functions.ids import chunk_key, id_of, remainder
from segspark.functions.shards import shard_column
from segspark.operators import algebra, maintenance
from segspark.plans import index, tiers
from segspark.store import SegmentStore
from segspark.streaming.ingest import day_buckets, trailing_active

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

URGENT, HIGH, MEDIUM, UNSPEC, LOW = "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"
NOW = 1_000_000_000_000 + 700 * 86_400_000
WIDE = 4099


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _p(spark: SparkSession, d: str, priority: str) -> DataFrame:
    rows = _t(spark, d, "orders").where((F.col("o_orderpriority") == priority) & F.col("o_custkey").isNotNull())
    return rows.select(F.col("o_custkey").cast("long").alias("id")).distinct()


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").where("o_custkey is not null and o_orderpriority is not null")
    return rows.select(F.col("o_orderpriority").alias("segment"), F.col("o_custkey").cast("long").alias("id")).distinct()


def _l(spark: SparkSession, d: str, flag: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").where(F.concat("l_returnflag", "l_linestatus") == flag)
    return rows.select(F.col("l_orderkey").cast("long").alias("id")).distinct()


def _wide(spark: SparkSession, d: str, status: str | None = None) -> DataFrame:
    rows = _t(spark, d, "orders")
    if status:
        rows = rows.where(F.col("o_orderstatus") == status)
    return rows.select((F.col("o_orderkey").cast("long") * WIDE).alias("id")).distinct()


def _sp(*priorities: str) -> list[str]:
    return [f"SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '{p}'" for p in priorities]


def _sl(*flags: str) -> list[str]:
    return [f"SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag || l_linestatus = '{f}'" for f in flags]


def _sw(status: str | None = None) -> str:
    return f"SELECT DISTINCT o_orderkey * {WIDE} AS id FROM orders" + (f" WHERE o_orderstatus = '{status}'" if status else "")


# Reads


@query("seg_has_batch", f"SELECT c_custkey AS id, c_custkey IN ({_sp(URGENT)[0]}) AS present FROM (SELECT DISTINCT c_custkey FROM customer)")
def _has(spark: SparkSession, d: str) -> DataFrame:
    return algebra.has_batch(_t(spark, d, "customer").select(F.col("c_custkey").alias("id")), _p(spark, d, URGENT))


@query("seg_count", f"SELECT count(*) AS n FROM ({_sp(URGENT)[0]})")
def _count(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, URGENT).agg(F.count("*").alias("n"))


@query("seg_count_all", "SELECT o_orderpriority AS segment, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def _count_all(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).groupBy("segment").agg(F.count("*").alias("n"))


@query("seg_count_index", "SELECT o_orderpriority AS segment, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def _count_index(spark: SparkSession, d: str) -> DataFrame:
    return index.chunk_index(_members(spark, d), "segment").groupBy("segment").agg(F.sum("cardinality").alias("n"))


@query("seg_iterate", _sp(HIGH)[0])
def _iterate(spark: SparkSession, d: str) -> DataFrame:
    return _p(spark, d, HIGH).orderBy("id")


@query("seg_intersect_2", " INTERSECT ".join(_sp(URGENT, HIGH)))
def _intersect2(spark: SparkSession, d: str) -> DataFrame:
    return algebra.intersect([_p(spark, d, URGENT), _p(spark, d, HIGH)])


@query("seg_intersect_3", " INTERSECT ".join(_sp(URGENT, HIGH, MEDIUM)))
def _intersect3(spark: SparkSession, d: str) -> DataFrame:
    return algebra.intersect([_p(spark, d, x) for x in (URGENT, HIGH, MEDIUM)])


@query("seg_intersect_lines", " INTERSECT ".join(_sl("AF", "RF", "NO")))
def _intersect_lines(spark: SparkSession, d: str) -> DataFrame:
    return algebra.intersect([_l(spark, d, x) for x in ("AF", "RF", "NO")])


@query("seg_intersect_self", _sp(URGENT)[0])
def _intersect_self(spark: SparkSession, d: str) -> DataFrame:
    a = _p(spark, d, URGENT)
    return algebra.intersect([a, a])


@query("seg_intersect_k1", _sp(LOW)[0])
def _intersect_k1(spark: SparkSession, d: str) -> DataFrame:
    return algebra.intersect([_p(spark, d, LOW)])


@query("seg_intersect_chunk_pruned", f"({_sw('F')}) INTERSECT ({_sw()} WHERE o_totalprice > 200000)")
def _intersect_pruned(spark: SparkSession, d: str) -> DataFrame:
    a = _wide(spark, d, "F")
    b = _t(spark, d, "orders").where("o_totalprice > 200000").select((F.col("o_orderkey").cast("long") * WIDE).alias("id")).distinct()
    keys = index.common_keys([x.select(chunk_key().alias("chunk_key")) for x in (a, b)])
    return algebra.intersect([algebra.within_chunks(a, keys), algebra.within_chunks(b, keys)])


@query("seg_union_2", " UNION ".join(_sp(URGENT, LOW)))
def _union2(spark: SparkSession, d: str) -> DataFrame:
    return algebra.union([_p(spark, d, URGENT), _p(spark, d, LOW)])


@query("seg_union_k", " UNION ".join(_sp(URGENT, HIGH, MEDIUM, UNSPEC, LOW)))
def _union_k(spark: SparkSession, d: str) -> DataFrame:
    return algebra.union([_p(spark, d, x) for x in (URGENT, HIGH, MEDIUM, UNSPEC, LOW)])


@query("seg_andnot", " EXCEPT ".join(_sp(URGENT, LOW)))
def _andnot(spark: SparkSession, d: str) -> DataFrame:
    return algebra.and_not(_p(spark, d, URGENT), [_p(spark, d, LOW)])


@query("seg_andnot_multi", f"({_sl('NO')[0]}) EXCEPT (({_sl('AF')[0]}) UNION ({_sl('RF')[0]}))")
def _andnot_multi(spark: SparkSession, d: str) -> DataFrame:
    return algebra.and_not(_l(spark, d, "NO"), [_l(spark, d, "AF"), _l(spark, d, "RF")])


@query("seg_intersect_exclude", "({} INTERSECT {}) EXCEPT {}".format(*_sp(URGENT, HIGH, LOW)))
def _intersect_exclude(spark: SparkSession, d: str) -> DataFrame:
    return algebra.intersect([_p(spark, d, URGENT), _p(spark, d, HIGH)], [_p(spark, d, LOW)])


@query("seg_union_exclude", "({} UNION {}) EXCEPT {}".format(*_sp(URGENT, HIGH, LOW)))
def _union_exclude(spark: SparkSession, d: str) -> DataFrame:
    return algebra.union([_p(spark, d, URGENT), _p(spark, d, HIGH)], [_p(spark, d, LOW)])


@query("seg_xor", "(({0}) UNION ({1})) EXCEPT (({0}) INTERSECT ({1}))".format(*_sp(URGENT, HIGH)))
def _xor(spark: SparkSession, d: str) -> DataFrame:
    return algebra.xor(_p(spark, d, URGENT), _p(spark, d, HIGH))


@query("seg_andor", "({}) INTERSECT (({}) UNION ({}))".format(*_sp(URGENT, HIGH, LOW)))
def _andor(spark: SparkSession, d: str) -> DataFrame:
    return algebra.and_or(_p(spark, d, URGENT), [_p(spark, d, HIGH), _p(spark, d, LOW)])


_MEMBERS = "SELECT DISTINCT o_orderpriority AS segment, o_custkey AS id FROM orders"


@query("seg_pair_overlap", f"""WITH m AS ({_MEMBERS}), s AS (SELECT segment, count(*) AS n FROM m GROUP BY 1),
c AS (SELECT x.segment AS a, y.segment AS b, count(*) AS n_common FROM m x JOIN m y ON x.id = y.id AND x.segment < y.segment GROUP BY 1, 2)
SELECT a, b, n_common, sa.n AS n_a, sb.n AS n_b, round(n_common / (sa.n + sb.n - n_common), 6) AS jaccard
FROM c JOIN s sa ON sa.segment = a JOIN s sb ON sb.segment = b""")
def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return algebra.pair_overlap(_members(spark, d))


@query("seg_intersect_count_bitmap", f"SELECT count(*) AS n FROM ({' INTERSECT '.join(_sl('AF', 'NO'))})")
def _bitmap_and(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.intersect_count(bitmaps.to_bitmaps(_l(spark, d, "AF")), bitmaps.to_bitmaps(_l(spark, d, "NO")))


@query("seg_andnot_count_bitmap", f"SELECT count(*) AS n FROM ({' EXCEPT '.join(_sl('AF', 'NO'))})")
def _bitmap_andnot(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.and_not_count(bitmaps.to_bitmaps(_l(spark, d, "AF")), bitmaps.to_bitmaps(_l(spark, d, "NO")))


@query("seg_union_bitmap", " UNION ".join(f"({x})" for x in _sl("AF", "RF")))
def _bitmap_or(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.expand(bitmaps.union_bitmaps(bitmaps.to_bitmaps(_l(spark, d, "AF")), bitmaps.to_bitmaps(_l(spark, d, "RF"))))


@query("seg_andnot_bitmap", " EXCEPT ".join(_sl("NO", "AF")))
def _bitmap_andnot_ids(spark: SparkSession, d: str) -> DataFrame:
    a, b = bitmaps.to_bitmaps(_l(spark, d, "NO")), bitmaps.to_bitmaps(_l(spark, d, "AF"))
    both = a.join(b.withColumnRenamed("bits", "other"), "half", "left")
    return bitmaps.expand(both.select("half", bitmaps.and_not_bits(F.col("bits"), F.col("other")).alias("bits")))


@query("bit_route", f"SELECT id, (id >> 16)::INT AS chunk_key, (id & 65535)::INT AS remainder, (id >> 16) * 65536 + (id & 65535) AS joined FROM ({_sw()})")
def _route(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(spark, d).select("id", chunk_key().alias("chunk_key"), remainder().alias("remainder"))
    return rows.withColumn("joined", id_of(F.col("chunk_key"), F.col("remainder")))


@query("chunk_index", f"SELECT (id >> 16)::INT AS chunk_key, count(*) AS cardinality, least(2 * count(*), 8192) AS bytes FROM ({_sw()}) GROUP BY 1")
def _index(spark: SparkSession, d: str) -> DataFrame:
    return index.chunk_index(_wide(spark, d)).drop("checksum")


@query("half_chunk_index", f"SELECT id >> 15 AS half, count(*) AS cardinality FROM ({_sw()}) GROUP BY 1")
def _half_index(spark: SparkSession, d: str) -> DataFrame:
    return index.half_chunk_index(_wide(spark, d))


@query("segment_size", f"SELECT sum(b)::BIGINT AS bytes FROM (SELECT least(2 * count(*), 8192) AS b FROM ({_sw()}) GROUP BY id >> 16)")
def _size(spark: SparkSession, d: str) -> DataFrame:
    return index.chunk_index(_wide(spark, d)).agg(F.sum("bytes").alias("bytes"))


def _keys(spark: SparkSession, d: str, where: str) -> DataFrame:
    rows = _t(spark, d, "orders").where(where)
    return rows.select(chunk_key(F.col("o_orderkey").cast("long") * WIDE).alias("chunk_key")).distinct()


_KEYS = f"SELECT DISTINCT (o_orderkey * {WIDE}) >> 16 AS k FROM orders WHERE "
_A, _B, _X = "o_totalprice > 300000", "o_orderpriority = '1-URGENT'", "o_orderstatus = 'P'"
_PRESENT = f"SELECT k, count(*) AS n FROM (({_KEYS}{_A}) UNION ALL ({_KEYS}{_B})) GROUP BY 1"


@query("intersect_efficiency", f"SELECT count(*) FILTER (n = 2) AS fetched, count(*) FILTER (n < 2) AS skipped FROM ({_PRESENT})")
def _efficiency(spark: SparkSession, d: str) -> DataFrame:
    return index.efficiency([_keys(spark, d, _A), _keys(spark, d, _B)])


@query("budget_units_combine", f"SELECT coalesce(sum(n + CASE WHEN x.k IS NULL THEN 0 ELSE 1 END), 0)::BIGINT AS units FROM ({_PRESENT}) p LEFT JOIN ({_KEYS}{_X}) x ON p.k = x.k WHERE n = 2")
def _units(spark: SparkSession, d: str) -> DataFrame:
    return index.combine_units([_keys(spark, d, _A), _keys(spark, d, _B)], [_keys(spark, d, _X)])


@query("expired_operand_algebra", " UNION ".join(_sp(URGENT, MEDIUM)))
def _expired(spark: SparkSession, d: str) -> DataFrame:
    """Of three operands one has expired: a union drops it."""
    operands = {URGENT: NOW + 1, HIGH: NOW, MEDIUM: None}
    live = [p for p, at in operands.items() if at is None or NOW < at]
    return algebra.union([_p(spark, d, p) for p in live])


# Tiers and mutation


def _cold(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").where(F.col("o_orderdate") < F.expr("timestamp_ntz'1999-01-01 00:00:00'"))
    return rows.select(F.col("o_orderpriority").alias("segment"), F.col("o_custkey").cast("long").alias("id")).distinct()


def _ops(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").where(F.col("o_orderdate") >= F.expr("timestamp_ntz'1999-01-01 00:00:00'"))
    return rows.select(F.col("o_orderpriority").alias("segment"), F.col("o_custkey").cast("long").alias("id"), (F.col("o_orderstatus") != "F").alias("add"), F.col("o_orderkey").cast("long").alias("seq"))


_EFFECTIVE = """SELECT segment, id FROM (
  SELECT segment, id, arg_max(add, seq) AS add FROM (
    SELECT o_orderpriority AS segment, o_custkey AS id, true AS add, -1 AS seq FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
    UNION ALL SELECT o_orderpriority, o_custkey, o_orderstatus <> 'F', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') GROUP BY 1, 2) WHERE add"""


@query("tier_effective", _EFFECTIVE)
def _effective(spark: SparkSession, d: str) -> DataFrame:
    return tiers.effective(_cold(spark, d), _ops(spark, d), "segment")


@query("tier_resolved_ops", "SELECT o_orderpriority AS segment, o_custkey AS id, arg_max(o_orderstatus <> 'F', o_orderkey) AS add FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1, 2")
def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return tiers.resolve(_ops(spark, d), "segment")


@query("tier_dirty_count", f"SELECT o_orderpriority AS segment, count(DISTINCT (o_orderkey * {WIDE}) >> 16) AS dirty FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1")
def _dirty(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").where(F.col("o_orderdate") >= F.expr("timestamp_ntz'1999-01-01 00:00:00'"))
    return tiers.dirty_chunks(rows.select(F.col("o_orderpriority").alias("segment"), (F.col("o_orderkey").cast("long") * WIDE).alias("id")), "segment")


def _store(spark: SparkSession, wide: bool = False) -> SegmentStore:
    """A store of its own for a query, in the folder that all executors share. W's ids pass 32 bits from order 1,047,809 on."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValidationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='segspark-')}"
    return SegmentStore(spark, f"{where.rstrip('/')}/store-{uuid.uuid4().hex}", clock=lambda: NOW / 1000, wide=wide)


def _tiered(spark: SparkSession, d: str, priority: str) -> SegmentStore:
    """A segment with a cold generation and three batches of operations on top, in the order of their keys."""
    store = _store(spark)
    store.bulk_load("s", _cold(spark, d).where(F.col("segment") == priority).select("id"))
    ops = _ops(spark, d).where(F.col("segment") == priority)
    last = tiers.resolve(ops)
    store.segment("s").remove_many(last.select("id").where("id % 7 = 0"))
    store.write_ops("_default", "s", last)
    return store


_EFFECTIVE_1 = f"SELECT id FROM ({_EFFECTIVE}) WHERE segment = '{URGENT}'"


@query("store_effective", _EFFECTIVE_1)
def _store_effective(spark: SparkSession, d: str) -> DataFrame:
    return _tiered(spark, d, URGENT).segment("s").ids()


@query("store_count", f"SELECT count(*) AS n FROM ({_EFFECTIVE_1})")
def _store_count(spark: SparkSession, d: str) -> DataFrame:
    store = _tiered(spark, d, URGENT)
    return store.effective_index(store.log.load(None, "s")).agg(F.sum("cardinality").alias("n"))


@query("compact_result", _EFFECTIVE_1)
def _compact(spark: SparkSession, d: str) -> DataFrame:
    store = _tiered(spark, d, URGENT)
    maintenance.compact(store, "s")
    return store.cold(store.log.load(None, "s")).select("id")


@query("compact_verify", f"SELECT count(*) AS n_ids, count(DISTINCT id >> 16) AS n_chunks, true AS verified FROM ({_EFFECTIVE_1})")
def _verify(spark: SparkSession, d: str) -> DataFrame:
    store = _tiered(spark, d, URGENT)
    out = maintenance.compact(store, "s")
    ok = store.verify_generation("_default", "s", out.to_gen)
    return store.cold_index(store.log.load(None, "s")).agg(F.sum("cardinality").alias("n_ids"), F.count("*").alias("n_chunks")).withColumn("verified", F.lit(ok))


@query("claim_many", f"(SELECT DISTINCT o_custkey AS id FROM orders) EXCEPT ({_sp(URGENT)[0]})")
def _claim(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.bulk_load("c", _p(spark, d, URGENT))
    return store.segment("c").claim_many(_t(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@query("claim_after_remove", f"({_sp(HIGH)[0]}) EXCEPT (({_sp(URGENT)[0]}) EXCEPT ({_sp(LOW)[0]}))")
def _claim_removed(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    store.bulk_load("c", _p(spark, d, URGENT))
    store.segment("c").remove_many(_p(spark, d, LOW))
    return store.segment("c").claim_many(_p(spark, d, HIGH))


def _into(spark: SparkSession, d: str) -> tuple[SegmentStore, dict]:
    store = _store(spark)
    for name, p in (("a", URGENT), ("b", HIGH), ("dest", LOW)):
        store.bulk_load(name, _p(spark, d, p))
    return store, {k: store.segment(k) for k in ("a", "b", "dest")}


@query("seg_union_into", " UNION ".join(_sp(URGENT, HIGH, LOW)))
def _union_into(spark: SparkSession, d: str) -> DataFrame:
    _, s = _into(spark, d)
    s["a"].union_into(s["dest"], [s["b"]])
    return s["dest"].ids()


@query("seg_intersect_into", "({}) UNION (({}) INTERSECT ({}))".format(*_sp(LOW, URGENT, HIGH)))
def _intersect_into(spark: SparkSession, d: str) -> DataFrame:
    _, s = _into(spark, d)
    s["a"].intersect_into(s["dest"], [s["b"]])
    return s["dest"].ids()


@query("seg_andnot_into", "({}) UNION (({}) EXCEPT ({}))".format(*_sp(LOW, URGENT, HIGH)))
def _andnot_into(spark: SparkSession, d: str) -> DataFrame:
    _, s = _into(spark, d)
    s["a"].and_not_into(s["dest"], [s["b"]])
    return s["dest"].ids()


@query("bulk_load_dedup", f"SELECT count(*) AS cardinality, count(DISTINCT id >> 16) AS chunk_count FROM (SELECT DISTINCT l_orderkey * {WIDE} AS id FROM lineitem)")
def _bulk(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, wide=True)
    store.bulk_load("w", _t(spark, d, "lineitem").select((F.col("l_orderkey").cast("long") * WIDE).alias("id")))
    return store.cold_index(store.log.load(None, "w")).agg(F.sum("cardinality").alias("cardinality"), F.count("*").alias("chunk_count"))


# Maintenance over a fleet


def _fleet(spark: SparkSession, d: str) -> DataFrame:
    """A registry-like table from customers: a segment for each, with made-up maintenance state."""
    k = F.col("c_custkey").cast("long")
    return _t(spark, d, "customer").select(
        F.lit("ns").alias("namespace"), F.concat(F.lit("c"), k.cast("string")).alias("segment"), k.alias("k"),
        F.when(k % 11 == 0, "destroyed").otherwise("active").alias("status"), (k % 9).alias("dirty"), (k % 7).alias("failures"),
        F.lit(NOW).cast("long").alias("updated_at"), F.when(k % 3 == 0, k * 1000).alias("last_compacted_at"), F.when(k % 5 != 0, k % 4).alias("current_gen"),
    )


_FLEET = f"""SELECT 'ns' AS namespace, 'c' || c_custkey AS segment, c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'destroyed' ELSE 'active' END AS status,
  c_custkey % 9 AS dirty, c_custkey % 7 AS failures, {NOW} AS updated_at, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 1000 END AS last_compacted_at,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 4 END AS current_gen FROM customer"""


@query("gc_generations", f"""WITH f AS ({_FLEET}), g AS (SELECT segment, unnest(range(6)) AS gen FROM f)
SELECT segment, gen FROM (SELECT segment, gen, status, current_gen, row_number() OVER (PARTITION BY segment, gen < current_gen ORDER BY gen DESC) AS pos FROM g JOIN f USING (segment))
WHERE status = 'destroyed' OR (gen < current_gen AND pos > 1)""")
def _gc(spark: SparkSession, d: str) -> DataFrame:
    f = _fleet(spark, d)
    gens = f.select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("gen"))
    return maintenance.generations_to_collect(gens, f)


@query("compaction_candidates", f"SELECT namespace, segment, dirty FROM ({_FLEET}) WHERE status <> 'destroyed' AND dirty >= 3 AND failures < 5 ORDER BY dirty DESC, coalesce(last_compacted_at, 0), namespace, segment LIMIT 40")
def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.compactable(_fleet(spark, d), NOW, 3, 40)


@query("compaction_skips", f"SELECT CASE WHEN status = 'destroyed' THEN 'destroyed' WHEN dirty = 0 THEN 'clean' WHEN failures >= 5 THEN 'quarantined' ELSE 'due' END AS reason, count(*) AS n FROM ({_FLEET}) GROUP BY 1")
def _skips(spark: SparkSession, d: str) -> DataFrame:
    f = _fleet(spark, d)
    reason = maintenance.skip_reason(F.col("status"), F.col("dirty"), F.col("failures"), F.col("updated_at"), NOW)
    return f.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_EXPIRIES = "SELECT 'o' || o_orderkey AS segment, o_orderkey * 86400000 + 1000000000000 AS expires_at FROM orders"


def _expiries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return _t(spark, d, "orders").select(F.concat(F.lit("o"), k.cast("string")).alias("segment"), (k * 86_400_000 + 1_000_000_000_000).alias("expires_at"))


@query("retention_eligible", f"SELECT segment, expires_at FROM ({_EXPIRIES}) WHERE expires_at <= {NOW}")
def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.due(_expiries(spark, d), NOW)


@query("due_buckets", f"SELECT expires_at // 86400000 AS bucket, count(*) AS n FROM ({_EXPIRIES}) GROUP BY 1")
def _due(spark: SparkSession, d: str) -> DataFrame:
    return _expiries(spark, d).groupBy(maintenance.due_bucket(F.col("expires_at")).alias("bucket")).agg(F.count("*").alias("n"))


@query("due_index_scan", f"SELECT segment FROM ({_EXPIRIES}) WHERE expires_at // 86400000 BETWEEN {NOW} // 86400000 - 7 AND {NOW} // 86400000 AND expires_at <= {NOW}")
def _due_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = _expiries(spark, d).withColumn("bucket", maintenance.due_bucket(F.col("expires_at")))
    return maintenance.due_by_index(rows, NOW).select("segment")


_POLICY = "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '[1]' WHEN 2 THEN '{\"owner\":\"x\"}' WHEN 3 THEN '{\"expiresAt\":' || (1000000000000 + k) || '}' WHEN 4 THEN '{\"expiresAt\":123}' ELSE '{\"expiresAt\":\"soon\"}' END"


@query("retention_policy_state", f"""SELECT k, CASE k % 6 WHEN 0 THEN 'none' WHEN 2 THEN 'none' WHEN 3 THEN 'ok' ELSE 'invalid' END AS state FROM (SELECT c_custkey AS k FROM customer)""")
def _policies(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("policy", F.expr(_POLICY))
    state = maintenance.policy_state(F.col("policy").isNotNull(), F.col("policy").startswith("{"), F.get_json_object("policy", "$.expiresAt"))
    return rows.select("k", state.alias("state"))


@query("subject_report", f"SELECT segment FROM ({_MEMBERS}) WHERE id = 7")
def _subject(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark, d).where("id = 7").select("segment")


@query("subject_report_store", f"SELECT segment FROM (SELECT DISTINCT lower(replace(o_orderpriority, ' ', '_')) AS segment, o_custkey AS id FROM orders) WHERE id = 7")
def _subject_store(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark)
    for p in (URGENT, HIGH, MEDIUM, UNSPEC, LOW):
        store.bulk_load(p.lower().replace(" ", "_"), _p(spark, d, p))
    return maintenance.subject_report(store, 7, all_namespaces=True).select("segment")


@query("erase_subject", f"SELECT id FROM ({_EFFECTIVE_1}) WHERE id <> 7")
def _erase(spark: SparkSession, d: str) -> DataFrame:
    store = _tiered(spark, d, URGENT)
    maintenance.erase_subject(store, 7, all_namespaces=True)
    return store.segment("s").ids()


@query("consistency_missing_gen", f"WITH f AS ({_FLEET}) SELECT segment, current_gen AS gen FROM f WHERE current_gen IS NOT NULL AND status <> 'destroyed' AND current_gen > k % 3")
def _missing(spark: SparkSession, d: str) -> DataFrame:
    f = _fleet(spark, d)
    gens = f.select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 3)).alias("gen"))
    return maintenance.missing_generations(f, gens)


@query("export_manifest", f"SELECT segment, count(*) AS ids FROM ({_MEMBERS}) GROUP BY 1")
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.export_manifest(_members(spark, d))


@query("roaring_round_trip", _MEMBERS)
def _roaring(spark: SparkSession, d: str) -> DataFrame:
    from segspark.sources.roaring import decode_chunks, encode_chunks

    return decode_chunks(encode_chunks(_members(spark, d), "segment"), "segment")


@query("sealed_round_trip", f"SELECT chunk_key, sum(id)::BIGINT AS total FROM (SELECT (id >> 16)::INT AS chunk_key, id FROM ({_sw()})) GROUP BY 1")
def _sealed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as text, sealed and opened; the sums show that they came back."""
    from segspark.crypto import seal, unseal

    key = bytes(range(32))
    rows = _wide(spark, d).groupBy(chunk_key().alias("chunk_key")).agg(F.sum("id").cast("string").cast("binary").alias("payload")).withColumn("generation", F.lit(0).cast("long"))
    return unseal(seal(rows, key, "ns", "s"), key, "ns", "s").select("chunk_key", F.col("payload").cast("string").cast("long").alias("total"))


# Dated buckets and cost


@query("daily_bucket_active", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS n_active FROM events GROUP BY 1")
def _daily(spark: SparkSession, d: str) -> DataFrame:
    return day_buckets(_t(spark, d, "events")).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n_active"))


@query("trailing_7d_active", """WITH b AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), e AS (SELECT DISTINCT day FROM b)
SELECT CAST(e.day AS VARCHAR) AS day, count(DISTINCT user_id) AS n_active FROM e JOIN b ON b.day <= e.day AND b.day > e.day - 7 GROUP BY 1""")
def _trailing(spark: SparkSession, d: str) -> DataFrame:
    return trailing_active(day_buckets(_t(spark, d, "events"))).select(F.col("day").cast("string").alias("day"), "n_active")


@query("type_day_intersect", """SELECT CAST(day AS VARCHAR) AS day, count(*) AS n FROM (
  SELECT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'click' INTERSECT SELECT CAST(ts AS DATE), user_id FROM events WHERE event_type = 'purchase') GROUP BY 1""")
def _type_day(spark: SparkSession, d: str) -> DataFrame:
    b = day_buckets(_t(spark, d, "events"), "ts", "user_id", "event_type")
    x, y = (b.where(F.col("event_type") == t).select("day", "id") for t in ("click", "purchase"))
    return x.join(y, ["day", "id"], "left_semi").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


_WORKLOAD = """SELECT c_custkey AS k, c_custkey * 1000003::DOUBLE AS size_bytes, (c_custkey % 50)::DOUBLE / 10 AS reads_per_sec, (c_custkey % 40)::DOUBLE AS writes_per_sec,
  (c_custkey % 4)::DOUBLE / 4 AS hit_rate, (c_custkey % 16 + 1)::DOUBLE AS item_kib, (c_custkey % 30)::DOUBLE AS compactions, (c_custkey % 5)::DOUBLE AS dirty_per_compaction FROM customer"""


def _workload(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    return _t(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), (k * 1000003.0).alias("size_bytes"), (k % 50 / 10).alias("reads_per_sec"), (k % 40).alias("writes_per_sec"),
        (k % 4 / 4).alias("hit_rate"), (k % 16 + 1).alias("item_kib"), (k % 30).alias("compactions"), (k % 5).alias("dirty_per_compaction"),
    )


_COST = f"""SELECT k, reads_per_sec * 2628000 * (1 - hit_rate) * rr AS reads, writes_per_sec * 2628000 * wr AS writes, size_bytes / 1073741824 * 0.023::DOUBLE AS storage,
  compactions * (ceil(size_bytes / (item_kib * 1024)) * (0.4::DOUBLE / 1e6) + 5.0::DOUBLE / 1e6) + compactions * dirty_per_compaction * (rr + wr) AS compaction FROM (
  SELECT *, greatest(1, ceil(item_kib / 4)) * (0.125::DOUBLE / 1e6) AS rr, greatest(1, ceil(item_kib)) * (0.625::DOUBLE / 1e6) AS wr FROM ({_WORKLOAD}))"""


@query("cost_fleet", f"SELECT k, round(reads, 9) AS reads, round(writes, 9) AS writes, round(storage, 9) AS storage, round(compaction, 9) AS compaction FROM ({_COST})")
def _cost(spark: SparkSession, d: str) -> DataFrame:
    return fleet_cost(_workload(spark, d), "B").select("k", *[F.round(c, 9).alias(c) for c in ("reads", "writes", "storage", "compaction")])


@query("cost_verdict", f"SELECT CASE WHEN t <= 34.6 THEN 'win-big' WHEN t < 346 THEN 'win' ELSE 'lose-zone' END AS verdict, count(*) AS n FROM (SELECT reads + writes + storage + compaction AS t FROM ({_COST})) GROUP BY 1")
def _verdict(spark: SparkSession, d: str) -> DataFrame:
    return fleet_cost(_workload(spark, d), "B").groupBy("verdict").agg(F.count("*").alias("n"))


# FNV-1a over the bytes of "namespace segment", a byte at a time.
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('ns ' || segment, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query("shard_assignment", f"SELECT segment, {_FNV} % 16 AS shard FROM ({_FLEET})")
def _shards(spark: SparkSession, d: str) -> DataFrame:
    f = _fleet(spark, d)
    return f.select("segment", shard_column(F.col("namespace"), F.col("segment"), 16).alias("shard"))


import segspark.catalog_store  # noqa: E402, F401  its queries register themselves
