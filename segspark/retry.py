"""Retries with exponential backoff and full jitter, for the driver's own commits; tasks are retried by Spark."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from segspark.errors import TransientError, ValidationError

T = TypeVar("T")


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 4
    base_s: float = 0.05
    factor: float = 2.0
    cap_s: float = 2.0

    def delay(self, attempt: int, rng: random.Random) -> float:
        return rng.random() * min(self.cap_s, self.base_s * self.factor**attempt)


#: For lost races: more and quicker.
CONFLICTS = RetryPolicy(attempts=16, base_s=0.005, cap_s=0.2)


def is_transient(e: BaseException) -> bool:
    return isinstance(e, (TransientError, ConnectionError, TimeoutError))


def with_retry(run: Callable[[], T], policy: RetryPolicy | None = None, when: Callable[[BaseException], bool] = is_transient, rng: random.Random | None = None, sleep: Callable[[float], None] = time.sleep) -> T:
    p = policy or RetryPolicy()
    if p.attempts < 1:
        raise ValidationError("attempts must be 1 or more")
    rng = rng or random.Random()
    for attempt in range(p.attempts):
        try:
            return run()
        except Exception as e:
            if attempt + 1 == p.attempts or not when(e):
                raise
            sleep(p.delay(attempt, rng))
    raise AssertionError("unreachable")
