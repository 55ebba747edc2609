"""Typed failures. Code names are stable; callers branch on the class."""

from __future__ import annotations


class SegmentError(Exception):
    """Base of all failures of this package."""


class ValidationError(SegmentError, ValueError):
    """An argument is outside its domain; nothing was read or written."""


class WriteConflictError(SegmentError):
    """Another writer got in between more often than a commit is retried."""


class IntegrityError(SegmentError):
    """Stored data contradicts itself."""


class NotFoundError(SegmentError):
    """Something named explicitly isn't there."""


class UnsupportedError(SegmentError):
    """A format version or feature this code doesn't know."""


class CapabilityError(SegmentError):
    """The configured storage can't do what was asked."""


class BudgetExceededError(SegmentError):
    """A call would touch more units than its budget; raised before any of them is touched."""

    def __init__(self, operation: str, units: int, budget: int):
        super().__init__(f"{operation} needs {units} units; the budget is {budget}")
        self.operation, self.units, self.budget = operation, units, budget


class KeyUnavailableError(SegmentError):
    """No key at hand unwraps the segment's data key."""


class TransientError(SegmentError):
    """May work when tried again."""


class TimeoutExceededError(TransientError):
    """A step took longer than it may."""
