"""The monthly cost of a workload: a Python function for one, column expressions for a fleet.

Both come from one set of formulas written over an arithmetic that works on numbers and on columns alike.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.errors import ValidationError

# A month in seconds, a GiB, and the default prices in USD (us-east-1, on demand).
MONTH = 730 * 3600
GIB = 1024**3


@dataclass(frozen=True)
class Pricing:
    cold_get_per_million: float = 0.4
    cold_put_per_million: float = 5.0
    storage_per_gib: float = 0.023
    rru_per_million: float = 0.125
    wru_per_million: float = 0.625
    read_unit_kib: float = 4.0
    write_unit_kib: float = 1.0
    strongly_consistent: bool = True
    flat_monthly: float = 346.0


# The workload's terms and their defaults.
TERMS = {
    "reads_per_sec": 0.0, "writes_per_sec": 0.0, "intersects_per_sec": 0.0, "hit_rate": 0.0, "item_kib": 8.0,
    "chunks_per_intersect": 1.0, "compactions": 0.0, "dirty_per_compaction": 0.0,
}
#: An advisory speaks from this many writes to a row and this saving on.
BATCHABLE_RATIO, BATCHABLE_SAVING = 8, 1.0


class _Numbers:
    ceil, least, greatest = staticmethod(math.ceil), staticmethod(min), staticmethod(max)

    @staticmethod
    def when(condition: bool, a: Any, b: Any) -> Any:
        return a if condition else b


class _Columns:
    ceil = staticmethod(F.ceil)

    @staticmethod
    def _lit(x: Any) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    @classmethod
    def least(cls, *xs: Any) -> Column:
        return F.least(*map(cls._lit, xs))

    @classmethod
    def greatest(cls, *xs: Any) -> Column:
        return F.greatest(*[cls._lit(x).cast("double") for x in xs])

    @classmethod
    def when(cls, condition: Any, a: Any, b: Any) -> Column:
        return F.when(condition if isinstance(condition, Column) else F.lit(bool(condition)), cls._lit(a)).otherwise(cls._lit(b))


def _formulas(size: Any, w: Mapping[str, Any], live_writes: bool, p: Pricing, m: Any) -> dict[str, Any]:
    hit = m.least(m.greatest(w["hit_rate"], 0.0), 1.0)
    warm_read = m.greatest(1.0, m.ceil(w["item_kib"] / p.read_unit_kib)) * (1.0 if p.strongly_consistent else 0.5) * (p.rru_per_million / 1e6)
    warm_write = m.greatest(1.0, m.ceil(w["item_kib"] / p.write_unit_kib)) * (p.wru_per_million / 1e6)
    get, put = p.cold_get_per_million / 1e6, p.cold_put_per_million / 1e6
    per_read = warm_read if live_writes else get
    reads = w["reads_per_sec"] * float(MONTH) * (1.0 - hit) * per_read
    writes = w["writes_per_sec"] * float(MONTH) * warm_write if live_writes else w["writes_per_sec"] * 0.0
    intersects = w["intersects_per_sec"] * float(MONTH) * w["chunks_per_intersect"] * get
    storage = size / float(GIB) * p.storage_per_gib
    chunks = w.get("chunks_per_compaction")
    if chunks is None:
        chunks = m.when(w["item_kib"] > 0, m.ceil(size / m.greatest(w["item_kib"] * 1024.0, 1e-9)), 0.0)
    compaction = w["compactions"] * (chunks * get + put) + w["compactions"] * w["dirty_per_compaction"] * (warm_read + warm_write)
    total = reads + writes + intersects + storage + compaction
    return {"reads": reads, "writes": writes, "intersects": intersects, "storage": storage, "compaction": compaction, "total": total, "per_read": per_read, "per_write": warm_write, "hit": hit}


def _check(name: str, x: float) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or x < 0:
        raise ValidationError(f"{name} must be finite and not negative: {x!r}")
    return float(x)


def segment_bytes(size_bytes: float | None = None, cardinality: float | None = None, count: float = 1) -> float:
    """Bytes of count segments: their size, else two for each id."""
    one = _check("size_bytes", size_bytes) if size_bytes is not None else 2 * _check("cardinality", cardinality or 0)
    return one * math.floor(_check("count", count))


def verdict(total: float, flat: float) -> str:
    return "win-big" if total <= 0.1 * flat else "win" if total < flat else "lose-zone"


def estimate(size: float, workload: Mapping[str, float] | None = None, topology: str = "A", pricing: Pricing | None = None, max_rows: int = 1 << 16) -> dict[str, Any]:
    """Cost by operation, total, crossovers against the flat baseline, verdict and advisories. Topology A loads
    in bulk and reads cold objects; B writes and reads live rows. max_rows bounds the rows the data can take."""
    if topology not in ("A", "B"):
        raise ValidationError(f"not a topology: {topology!r}")
    p = pricing or Pricing()
    for name, value in vars(p).items():
        if name != "strongly_consistent":
            _check(f"pricing.{name}", value)
    if not p.read_unit_kib or not p.write_unit_kib:
        raise ValidationError("units must be positive")
    extra = set(workload or {}) - set(TERMS) - {"chunks_per_compaction"}
    if extra:
        raise ValidationError(f"not terms of a workload: {sorted(extra)}")
    w = {k: _check(k, v) for k, v in (TERMS | dict(workload or {})).items()}
    out = _formulas(_check("size", size), w, topology == "B", p, _Numbers)
    head = max(0.0, p.flat_monthly - out["storage"])
    miss = 1 - out["hit"]
    out["writes_crossover"] = head / (MONTH * out["per_write"]) if topology == "B" and out["per_write"] else math.inf
    out["reads_crossover"] = head / (MONTH * out["per_read"] * miss) if out["per_read"] and miss else math.inf
    out["verdict"] = verdict(out["total"], p.flat_monthly)
    rows, floor = w["writes_per_sec"] * MONTH, max_rows * out["per_write"]
    saves = out["writes"] and max_rows and rows / max_rows >= BATCHABLE_RATIO and out["writes"] - floor >= BATCHABLE_SAVING
    out["advisories"] = [{"code": "batchable-writes", "current": out["writes"], "floor": floor}] if saves else []
    return out


def fleet_cost(df: DataFrame, topology: str = "A", pricing: Pricing | None = None) -> DataFrame:
    """df has size_bytes and any workload terms; adds reads, writes, intersects, storage, compaction, total and
    verdict, without Python."""
    p = pricing or Pricing()
    w = {k: (F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in df.columns else F.lit(v)) for k, v in TERMS.items()}
    if "chunks_per_compaction" in df.columns:
        w["chunks_per_compaction"] = F.col("chunks_per_compaction").cast("double")
    f = _formulas(F.col("size_bytes").cast("double"), w, topology == "B", p, _Columns)
    out = df.select("*", *[f[k].alias(k) for k in ("reads", "writes", "intersects", "storage", "compaction", "total")])
    return out.withColumn("verdict", F.when(F.col("total") <= 0.1 * p.flat_monthly, "win-big").when(F.col("total") < p.flat_monthly, "win").otherwise("lose-zone"))
