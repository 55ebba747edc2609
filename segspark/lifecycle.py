"""One maintenance cycle (retention, then compaction) under a lease, and a loop around it."""

from __future__ import annotations

import json
import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from segspark.errors import ValidationError, WriteConflictError
from segspark.operators.maintenance import retire_expired, run_compaction_cycle
from segspark.store import SegmentStore

#: Every so many cycles the whole fleet is asked for expiries, in others only the due index.
REPAIR_EVERY = 24
CYCLE_MS = 60_000


def run_cycle(store: SegmentStore, max_segments: int = 64, min_dirty: int = 1, retire: bool = True, cycle_ms: int = CYCLE_MS, repair_every: int = REPAIR_EVERY) -> dict[str, Any]:
    """One cycle, unless another worker has this one: time is cut in slots of cycle_ms, and a slot belongs to who first
    creates its file, which says what it is the number of. The first cycle and every repair_every-th scan the fleet for
    expiries. Phases don't fail each other: what one raises is in its result."""
    if cycle_ms < 1 or repair_every < 1:
        raise ValidationError("cycle_ms and repair_every must be 1 or more")
    files, slot = store.log.files, store.log.now() // cycle_ms
    folder = files.path("lifecycle")
    before = sorted(int(x[:-5]) for x in files.names(folder) if x.endswith(".json") and not x.startswith("."))
    last = [x for x in before if x < slot]
    number = json.loads(files.read(f"{folder}/{last[-1]:015d}.json"))["cycle"] + 1 if last else 1
    try:
        files.create(f"{folder}/{slot:015d}.json", json.dumps({"cycle": number}).encode())
    except WriteConflictError:
        return {"skipped": "leased-by-other", "slot": slot}
    for x in last[:-1]:
        files.delete(f"{folder}/{x:015d}.json")
    scan = number == 1 or number % repair_every == 0
    out: dict[str, Any] = {"cycle": number, "scan": scan}
    for name, phase in (("retention", lambda: retire_expired(store, scan=scan) if retire else None), ("compaction", lambda: run_compaction_cycle(store, max_segments, min_dirty))):
        try:
            out[name] = phase()
        except Exception as e:
            out[name] = {"error": str(e)}
    return out


@dataclass
class MaintenanceLoop:
    """Cycles at an interval; after failures longer apart, up to a limit. stop() waits for the cycle that runs."""

    cycle: Callable[[], Any]
    interval_s: float = 60.0
    max_s: float = 900.0
    jitter: float = 0.1
    rng: random.Random = field(default_factory=random.Random)
    cycles: int = 0
    failures: int = 0
    last_ok: float | None = None
    last_error: str | None = None

    def __post_init__(self) -> None:
        if not 0 < self.interval_s <= self.max_s or not 0 <= self.jitter < 1:
            raise ValidationError("interval, limit or jitter out of bounds")
        self._stop, self._thread = threading.Event(), None

    def delay(self) -> float:
        base = min(self.max_s, self.interval_s * 2**self.failures)
        return base * (1 + self.jitter * (2 * self.rng.random() - 1))

    def once(self) -> bool:
        self.cycles += 1
        try:
            self.cycle()
        except Exception as e:
            self.failures, self.last_error = self.failures + 1, str(e)
            return False
        self.failures, self.last_ok = 0, time.time()
        return True

    def start(self) -> None:
        def run() -> None:
            while not self._stop.is_set():
                self.once()
                self._stop.wait(self.delay())

        if self._thread is None:
            self._thread = threading.Thread(target=run, daemon=True)
            self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()

    def healthy(self) -> bool:
        return self.failures == 0
