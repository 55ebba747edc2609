"""Names of namespaces and segments."""

from __future__ import annotations

import re

from segspark.errors import ValidationError

# Fixed value: the grammar both parts follow.
GRAMMAR = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,255}")
#: Stands for no namespace; no valid name starts with an underscore.
DEFAULT_NAMESPACE = "_default"


def check_name(value: str, what: str = "segment") -> str:
    if not isinstance(value, str) or not GRAMMAR.fullmatch(value) or ".." in value:
        raise ValidationError(f"not a {what} name: {value!r}")
    return value


def namespace_key(namespace: str | None) -> str:
    return DEFAULT_NAMESPACE if namespace in (None, DEFAULT_NAMESPACE) else check_name(namespace, "namespace")
