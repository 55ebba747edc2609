"""Ids beyond 32 bits: the queries over W on orders so many that its ids pass 2**32, and wide stores."""

from __future__ import annotations

import duckdb
import pytest

from segspark import catalog
from segspark import store as stores
from segspark.crypto import Keyring
from segspark.errors import ValidationError
from segspark.operators import maintenance as m
from segspark.store import SegmentStore
from tests.conftest import ids
from tests.test_catalog import rows

BIG = 1 << 32


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Orders and line items thrice, with keys as they are, across 2**32 / 4099 and at 9,000,000."""
    at = tmp_path_factory.mktemp("many")
    for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        duckdb.execute(f"COPY (SELECT * REPLACE ({k} + shift AS {k}) FROM '/root/testdata/sf0.001/{t}.parquet', (VALUES (0), (1047000), (9000000)) v(shift)) TO '{at}/{t}.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["bulk_load_dedup", "fleet_dirty", "compaction_cycle", "lines_round_trip", "container_round_trip", "sealed_store"])
def test_query_beyond_32_bits_matches_sql(spark, many, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{many}/{t}.parquet'")
    df = catalog.queries()[name](spark, many)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_wide_store(spark, tmp_path):
    """The same calls as on a narrow store, on ids on both sides of 2**32 whose lower halves agree."""
    store = SegmentStore(spark, f"file://{tmp_path}/store", wide=True)
    a, b = store.segment("a"), store.segment("b")
    got = store.bulk_load("a", [5, BIG + 5, BIG + 5, 7 * BIG + 70000, (1 << 47) - 1])
    store.bulk_load("b", [5, 6, BIG + 6, 7 * BIG + 70000])
    assert (got["cardinality"], got["chunk_count"]) == (4, 4) and store.verify_generation("_default", "a", 0)
    assert ids(a.intersect([b])) == [5, 7 * BIG + 70000] and ids(a.and_not([b])) == [BIG + 5, (1 << 47) - 1]
    assert a.intersect_efficiency([b]) == {"fetched": 3, "skipped": 1}
    assert ids(a.claim_many([5, 6, BIG + 5, 2 * BIG])) == [6, 2 * BIG]
    a.remove_many([BIG + 5])
    want = [5, 6, 2 * BIG, 7 * BIG + 70000, (1 << 47) - 1]
    assert ids(a.ids()) == want and a.count() == 5 and ids(a.intersect([b])) == [5, 6, 7 * BIG + 70000]
    m.compact(store, "a")
    assert ids(a.ids()) == want and a.count() == 5 and [a.has(x) for x in (5, BIG + 5, 2 * BIG)] == [True, False, True]
    assert [r["segment"] for r in m.subject_report(store, BIG + 6, all_namespaces=True).collect()] == ["b"]
    for bad in ([-1], [1 << 47]):
        with pytest.raises(ValidationError):
            a.add_many(bad)
    with pytest.raises(ValidationError):
        SegmentStore(spark, store.root).segment("a").add(BIG)


@pytest.mark.parametrize("sealed", [False, True])
def test_sparse_ids_share_folders(spark, tmp_path, monkeypatch, sealed):
    """600 ids, none of which share 256 chunk keys, aren't in 600 folders, and each is found in its own."""
    store = SegmentStore(spark, f"file://{tmp_path}/store", wide=True, keyring=Keyring(spark, {"main": b"m" * 32}) if sealed else None)
    a, sparse = store.segment("a"), [i << 25 for i in range(600)]
    want = [*sparse[1:], sparse[-1] + 7]

    def folders() -> int:
        s = a.state()
        return sum(n.startswith("kb=") for n in store.log.files.names(store.generation_path("_default", "a", s.current_gen, s.gen_attempt)))

    store.bulk_load("a", [*sparse[:-1], 1 << 20])
    assert folders() == 1
    a.add_many([*sparse[300:], sparse[-1] + 7])
    a.remove_many([0, 1 << 20])
    monkeypatch.setattr(stores, "FOLDER_IDS", 100)
    assert m.compact(store, "a").compacted and 2 <= folders() <= 6
    assert store.verify_generation("_default", "a", 1, store.key(a.state())) and ids(a.ids()) == want and a.count() == 600
    assert [a.has(x) for x in (0, sparse[1], sparse[300], sparse[-1] + 7, sparse[-1] + 8)] == [False, True, True, True, False]
    # Published without counts: how wide the folders are isn't known.
    store.write_generation("_default", "a", 2, store.cold(a.state()).select("id"), store.key(a.state()))
    assert store.publish("_default", "a", 2) and store.folder_keys(a.state()) is None
    assert [a.has(x) for x in (0, sparse[1], sparse[-1] + 7)] == [False, True, True]


def test_folders_of_256_chunk_keys(spark, tmp_path, monkeypatch):
    """Where ids are dense, and in generations from before folders could be wider."""
    store = SegmentStore(spark, f"file://{tmp_path}/store", wide=True)
    store.bulk_load("dense", spark.range(200_000))
    monkeypatch.setattr(SegmentStore, "_folder_keys", lambda *_: stores.KEYS_PER_FOLDER)
    store.bulk_load("old", [5, 1 << 30, BIG + 5])
    dense, old = store.segment("dense"), store.segment("old")
    assert [store.folder_keys(x.state()) for x in (dense, old)] == [256, 256]
    assert [old.has(x) for x in (5, 6, 1 << 30, BIG + 5)] == [True, False, True, True] and dense.has(199_999)
