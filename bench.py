"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then twice, whole, into a sink that reads every row; the better time counts. Beside
common, a bulk load, a count from the index, a compaction, a fleet of $BENCH_FLEET segments of 256 ids read whole and asked for what to
compact, and the floor of a Spark job that does nothing.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LOAD = int(os.environ.get("BENCH_LOAD_IDS", "10000000"))
FLEET = int(os.environ.get("BENCH_FLEET", "1000"))

HEADLINE = [
    "seg_has_batch", "seg_count_all", "seg_count_index", "seg_intersect_2", "seg_intersect_3", "seg_intersect_lines", "seg_union_k",
    "seg_andnot_multi", "seg_intersect_exclude", "seg_xor", "seg_pair_overlap", "seg_intersect_count_bitmap", "seg_andnot_count_bitmap",
    "chunk_index", "intersect_efficiency", "tier_effective", "trailing_7d_active", "cost_fleet", "due_buckets",
]


def timed(run) -> float:
    run()
    best = float("inf")
    for _ in range(2):
        t = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - t)
    return best


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{scratch}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from segspark import catalog
    from segspark.operators.maintenance import compact, compactable
    from segspark.store import SegmentStore, fleet, fleet_dirty

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    queries: dict[str, float] = {"spark_job_floor": timed(lambda: noop(spark.range(1)))}
    for name in HEADLINE:
        queries[name] = timed(lambda name=name: noop(catalog.queries()[name](spark, SF_DIR)))
    facts: dict[str, float] = {}

    store = SegmentStore(spark, f"file://{scratch}/store")
    chunk = lambda first: (F.col("id") % 2000 + first) * 65536 + F.col("id").cast("long") / 2000
    for name, first in (("a", 0), ("b", 1900)):
        store.bulk_load(name, spark.range(2_000_000).select(chunk(first).cast("long").alias("id")))
    a, b = store.segment("a"), store.segment("b")
    queries["intersect_2m_2m"] = timed(lambda: noop(a.intersect([b], budget=False)))
    queries["count_2m_by_index"] = timed(a.count)
    queries["count_2m_by_scan"] = timed(lambda: a.ids().count())
    queries["has_2m"] = timed(lambda: a.has(65537))
    facts |= a.intersect_efficiency([b])

    n = 0

    def load() -> None:
        nonlocal n
        n += 1
        store.bulk_load(f"load{n}", spark.range(LOAD).select((F.xxhash64("id") % (1 << 31) + (1 << 31)).alias("id")))

    queries["bulk_load"] = timed(load)
    facts["bulk_load_ids_per_sec"] = round(LOAD / queries["bulk_load"])
    store.segment("load1").add_many(spark.range(0, 4_000_000, 4))
    t = time.perf_counter()
    compact(store, "load1")
    queries["compact"] = time.perf_counter() - t
    facts["compact_ids_per_sec"] = round(LOAD / queries["compact"])

    fleet_store = SegmentStore(spark, f"file://{scratch}/fleet")
    rows = spark.range(FLEET * 256).select(F.lit("_default").alias("ns"), F.concat(F.lit("f"), (F.col("id") / 256).cast("long")).alias("segment"), F.col("id") % 256 * 65536)
    rows = rows.toDF("ns", "segment", "id").withColumn("gen", F.lit(0)).withColumn("attempt", F.lit("a")).withColumn("kb", F.expr("int((id >> 16) div 256)"))
    rows.repartition("segment").write.partitionBy("ns", "segment", "gen", "attempt", "kb").parquet(f"file://{scratch}/fleet/cold")
    t = time.perf_counter()
    for i in range(FLEET):
        fleet_store.log.update(None, f"f{i}", lambda s: {"current_gen": 0, "gen_attempt": "a", "gen_stats": {"cardinality": 256}})
    facts["fleet_commits_per_sec"] = round(FLEET / (time.perf_counter() - t))
    fleet_store.segment("f1").add_many([7, 70000])
    queries["fleet_read"] = timed(lambda: noop(fleet(fleet_store)))
    discover = lambda: compactable(fleet_store.registry().join(fleet_dirty(fleet_store), ["namespace", "segment"]), fleet_store.log.now(), 1, 64).collect()
    queries["fleet_discovery"] = timed(discover)
    facts["fleet_segments"] = FLEET
    store.spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": {k: round(v, 4) for k, v in queries.items()}, "facts": facts, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
