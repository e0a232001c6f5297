"""SQL literals: the only place where text becomes part of an expression."""

from __future__ import annotations

_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}


def text(value: str) -> str:
    """A string literal."""
    return "'" + "".join(_ESCAPES.get(c, c) for c in value) + "'"


def name(value: str) -> str:
    """A quoted identifier."""
    return "`" + value.replace("`", "``") + "`"


def any_of(terms: list[str]) -> str:
    return "(" + " OR ".join(terms) + ")" if terms else "false"


def sure(condition: str) -> str:
    """Two-valued: unknown is false."""
    return f"coalesce({condition}, false)"
