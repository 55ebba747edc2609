"""Request budgets: units are counted on the index before anything is read."""

from __future__ import annotations

from segspark.errors import BudgetExceededError, ValidationError

DEFAULT_BUDGET = 1_000_000
#: Bytes of pending operations a read may merge, whatever the budget.
MAX_PENDING_BYTES = 64 << 20


def resolve_budget(own: int | bool | None, inherited: int | bool | None = None) -> int | None:
    """The budget that holds: a call's own, else the store's, else the default; False means none."""
    for b in (own, inherited):
        if b is None:
            continue
        if b is False:
            return None
        if isinstance(b, bool) or not isinstance(b, int) or b < 0:
            raise ValidationError(f"not a budget: {b!r}")
        return b
    return DEFAULT_BUDGET


def check_budget(operation: str, units: int, budget: int | None) -> None:
    if budget is not None and units > budget:
        raise BudgetExceededError(operation, units, budget)
