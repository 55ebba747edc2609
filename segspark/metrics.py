"""Events of operations and of governance. A sink that fails never fails the operation."""

from __future__ import annotations

import json
import logging
import threading
from collections import Counter
from typing import Any, Protocol

_log = logging.getLogger("segspark")


class Sink(Protocol):
    def event(self, kind: str, fields: dict[str, Any]) -> None: ...


class CountingSink:
    """Counts events, and sums their numbers, by kind; every operation has a slot."""

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.sums: Counter[str] = Counter()
        self._lock = threading.Lock()

    def event(self, kind: str, fields: dict[str, Any]) -> None:
        with self._lock:
            self.counts[kind] += 1
            for k, v in fields.items():
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    self.sums[f"{kind}.{k}"] += v


class RecordingSink:
    def __init__(self) -> None:
        self.events: list[tuple[str, dict[str, Any]]] = []

    def event(self, kind: str, fields: dict[str, Any]) -> None:
        self.events.append((kind, fields))


class JsonLines:
    """Appends each event as a line: for audit trails on the driver's disk."""

    def __init__(self, path: str):
        self.path = path

    def event(self, kind: str, fields: dict[str, Any]) -> None:
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"kind": kind} | fields, default=str, sort_keys=True) + "\n")


class Safe:
    def __init__(self, sink: Sink | None):
        self.sink = sink

    def event(self, kind: str, **fields: Any) -> None:
        if self.sink is None:
            return
        try:
            self.sink.event(kind, fields)
        except Exception:
            _log.exception("a sink failed on %s", kind)
