from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from segspark.errors import ValidationError
from segspark.functions import bitmaps
from segspark.functions.ids import MAX_ID, guarded, id_frame
from segspark.functions.shards import shard_column, shard_of
from segspark.operators import algebra
from segspark.plans import index, tiers
from tests.conftest import ids

A, B = [1, 2, 3, 100, 200000], [2, 3, 4, 200000, 999]


def frame(spark, values):
    return id_frame(spark, values)


def test_two_segments(spark):
    a, b = frame(spark, A), frame(spark, B)
    assert ids(algebra.intersect([a, b])) == [2, 3, 200000]
    assert ids(algebra.intersect([a, b], [frame(spark, [3])])) == [2, 200000]
    assert ids(algebra.intersect([a])) == A
    assert ids(algebra.union([a, b])) == sorted({*A, *B})
    assert ids(algebra.and_not(a, [b])) == [1, 100]
    assert ids(algebra.xor(a, b)) == [1, 4, 100, 999]
    assert ids(algebra.and_or(a, [b, frame(spark, [1])])) == [1, 2, 3, 200000]


def test_edges(spark):
    empty, top = frame(spark, []), frame(spark, [MAX_ID, 0, 65535, 65536])
    assert ids(algebra.intersect([top, empty])) == []
    assert ids(algebra.union([top, empty])) == [0, 65535, 65536, MAX_ID]
    assert ids(algebra.and_not(top, [empty])) == [0, 65535, 65536, MAX_ID]
    for call in (lambda: algebra.union([]), lambda: algebra.intersect([]), lambda: algebra.and_not(top, [])):
        with pytest.raises(ValidationError):
            call()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 300_000), max_size=60), min_size=3, max_size=3))
def test_against_sets(spark, lists):
    a, b, c = ({*x} for x in lists)
    fa, fb, fc = (frame(spark, x) for x in lists)
    tagged = algebra.intersect([fa, fb], [fc]).withColumn("k", F.lit("i")).union(algebra.union([fa, fb], [fc]).withColumn("k", F.lit("u"))).union(algebra.and_not(fa, [fb, fc]).withColumn("k", F.lit("n")))
    got = {"i": set(), "u": set(), "n": set()}
    for r in tagged.collect():
        assert r["id"] not in got[r["k"]]
        got[r["k"]].add(r["id"])
    assert got == {"i": (a & b) - c, "u": (a | b) - c, "n": a - b - c}


def test_bad_ids_fail_the_job(spark):
    for bad in (-1, 1 << 32, None):
        with pytest.raises(Exception, match="unsigned 32-bit"):
            spark.createDataFrame([(bad,)], "v long").select(guarded(F.col("v")).alias("id")).collect()


def test_bitmaps(spark):
    values = [0, 32767, 32768, 65535, 65536, MAX_ID]
    a, b = bitmaps.to_bitmaps(frame(spark, values)), bitmaps.to_bitmaps(frame(spark, [32767, 65536, 99_999_999]))
    assert ids(bitmaps.expand(a)) == values
    assert bitmaps.intersect_count(a, b).first()["n"] == 2
    assert bitmaps.and_not_count(a, b).first()["n"] == 4
    assert ids(bitmaps.expand(bitmaps.union_bitmaps(a, b))) == sorted({*values, 99_999_999})


def test_index_and_budget_units(spark):
    spread = lambda lo, hi: frame(spark, [(c << 16) + i + 1 for c in range(lo, hi) for i in range(3)])
    a, b, x = (index.chunk_index(spread(*r)) for r in ((1, 4), (3, 6), (3, 5)))
    assert index.efficiency([a, b]).first().asDict() == {"fetched": 1, "skipped": 4}
    assert index.combine_units([a, b]).first()["units"] == 2
    assert index.combine_units([a, b], [x]).first()["units"] == 3
    assert index.combine_units([a, b], [x], any_of=True).first()["units"] == 8
    assert {r["chunk_key"]: r["cardinality"] for r in a.collect()} == {1: 3, 2: 3, 3: 3}


def test_last_operation_wins(spark):
    cold = frame(spark, [1, 2, 3])
    ops = spark.createDataFrame([(1, False, 0), (4, True, 0), (4, False, 1), (2, False, 1), (2, True, 2), (5, True, 3), (5, True, 4)], "id long, add boolean, seq long")
    assert ids(tiers.effective(cold, ops)) == [2, 3, 5]
    assert ids(tiers.overlay(cold, ops)) == [2, 3, 5]


def test_pair_overlap(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9)]
    got = algebra.pair_overlap(spark.createDataFrame(rows, "segment string, id long")).collect()
    assert [(r["a"], r["b"], r["n_common"], r["jaccard"]) for r in got] == [("a", "b", 1, 0.333333)]


def test_shard_column_is_the_function(spark):
    rows = [("ns", f"seg-{i}é") for i in range(20)]
    got = spark.createDataFrame(rows, "n string, s string").select("n", "s", shard_column(F.col("n"), F.col("s"), 7).alias("k")).collect()
    assert all(r["k"] == shard_of(r["n"], r["s"], 7) for r in got)


def test_plans(spark, sf):
    """Filters and columns reach the scan, and an intersection of small sides is one broadcast semi join."""
    from segspark.catalog import queries

    plan = queries()["seg_intersect_exclude"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in plan
    assert "LeftSemi" in plan and "LeftAnti" in plan and "Cartesian" not in plan and "coalesce" not in plan
