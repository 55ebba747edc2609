from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segspark import errors
from segspark.functions import cost, ids, names, shards
from segspark.plans.budget import DEFAULT_BUDGET, check_budget, resolve_budget
from segspark.retry import RetryPolicy, with_retry
from segspark.sources import container, roaring


def test_id_route_and_bounds():
    for v in (0, 1, 65535, 65536, 131072, ids.MAX_ID):
        assert ids.join_id(*ids.split_id(v)) == v
    for bad in (-1, 1 << 32, 1.0, "1", None, True):
        with pytest.raises(errors.ValidationError):
            ids.check_id(bad)
    with pytest.raises(errors.ValidationError):
        ids.join_id(65536, 0)


@pytest.mark.parametrize("name", ["a", "A.b-c_9", "x" * 256])
def test_names_ok(name):
    assert names.check_name(name) == name


@pytest.mark.parametrize("name", ["", "_a", ".a", "-a", "a..b", "a/b", "a b", "x" * 257, "é", "a\n", None])
def test_names_refused(name):
    with pytest.raises(errors.ValidationError):
        names.check_name(name)


def test_default_namespace_cannot_collide():
    assert names.namespace_key(None) == names.DEFAULT_NAMESPACE
    with pytest.raises(errors.ValidationError):
        names.check_name(names.DEFAULT_NAMESPACE)


def test_fnv_known_values():
    assert shards.fnv1a(b"") == 0x811C9DC5
    assert shards.fnv1a(b"a") == 0xE40C292C
    assert shards.fnv1a(b"foobar") == 0xBF9CF968


def test_cost_anchors():
    b = cost.estimate(1.2 * cost.GIB, {"item_kib": 8}, "B")
    assert round(b["writes_crossover"], 2) == 26.33
    assert round(b["reads_crossover"], 2) == 526.64 or math.isclose(b["reads_crossover"], 526.6, rel_tol=1e-3)
    a = cost.estimate(1.2 * cost.GIB, {}, "A")
    assert round(a["reads_crossover"]) == 329
    assert a["writes_crossover"] == math.inf
    assert round(a["storage"], 4) == 0.0276 and a["verdict"] == "win-big"


def test_cost_verdicts_and_advisory():
    assert cost.verdict(34.6, 346) == "win-big" and cost.verdict(345, 346) == "win" and cost.verdict(346, 346) == "lose-zone"
    many = cost.estimate(0, {"writes_per_sec": 100}, "B", max_rows=1000)
    assert [x["code"] for x in many["advisories"]] == ["batchable-writes"]
    assert cost.estimate(0, {"writes_per_sec": 100}, "A", max_rows=1000)["advisories"] == []
    for bad in ({"writes_per_sec": -1}, {"hit_rate": math.nan}, {"nothing": 1}):
        with pytest.raises(errors.ValidationError):
            cost.estimate(0, bad)
    assert cost.segment_bytes(cardinality=10, count=2.9) == 40


def test_budget_resolution():
    assert resolve_budget(None) == DEFAULT_BUDGET
    assert resolve_budget(None, 5) == 5 and resolve_budget(3, 5) == 3 and resolve_budget(False, 5) is None
    for bad in (True, -1, 1.5):
        with pytest.raises(errors.ValidationError):
            resolve_budget(bad)
    check_budget("x", 10, 10)
    with pytest.raises(errors.BudgetExceededError) as e:
        check_budget("x", 11, 10)
    assert (e.value.units, e.value.budget) == (11, 10)


def test_retry_only_transient():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise errors.TransientError
        return "ok"

    assert with_retry(flaky, RetryPolicy(), sleep=lambda _: None, rng=random.Random(1)) == "ok"
    with pytest.raises(errors.IntegrityError):
        with_retry(lambda: (_ for _ in ()).throw(errors.IntegrityError("x")), sleep=lambda _: None)


_ids = st.lists(st.one_of(st.integers(0, (1 << 32) - 1), st.integers(0, 70_000)), max_size=300)


@settings(max_examples=80, deadline=None)
@given(_ids, st.integers(0, 5), st.integers(0, 9000))
def test_roaring_round_trip(values, start, run):
    values = values + list(range(start * 65536, start * 65536 + run))
    data = roaring.encode(np.array(values, np.int64))
    want = sorted(set(values))
    assert roaring.decode(data).tolist() == want
    assert roaring.count(data) == len(want)
    for v in [*want[:5], 12345, 4]:
        assert roaring.has(data, v) == (v in set(want))


@settings(max_examples=60, deadline=None)
@given(_ids)
def test_container_round_trip(values):
    c = container.Container(container.write(np.array(values, np.int64), 7))
    assert c.ids().tolist() == sorted(set(values))
    assert c.count() == len(set(values)) and c.generation == 7


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 400), st.integers(1, 255))
def test_container_damage_is_a_typed_error(at, flip):
    data = bytearray(container.write(np.array([1, 2, 3, 70_000, 140_001] + list(range(200_000, 200_050)), np.int64)))
    data[at % len(data)] ^= flip
    try:
        got = container.Container(bytes(data)).ids().tolist()
    except (errors.IntegrityError, errors.UnsupportedError):
        return
    assert len(got) == 55  # only bytes that mean nothing were changed


def test_container_cut_short_and_crc():
    assert container.crc32c(b"123456789") == 0xE3069283
    data = container.write(np.array([1, 2, 3]))
    for n in (0, 10, len(data) - 1):
        with pytest.raises(errors.IntegrityError):
            container.Container(data[:n])
    with pytest.raises(errors.ValidationError):
        container.write_chunks(iter([(2, b"x", 1), (1, b"x", 1)]))
