"""Nested options by dotted path, compared and merged."""

from __future__ import annotations

from typing import Any


def get(options: dict, path: str) -> Any:
    for key in path.split("."):
        if not isinstance(options, dict) or key not in options:
            return None
        options = options[key]
    return options


def put(options: dict, path: str, value: Any) -> dict:
    """A copy with one value set; what stands in the way is replaced."""
    head, _, rest = path.partition(".")
    if not rest:
        return options | {head: value}
    inner = options.get(head)
    return options | {head: put(inner if isinstance(inner, dict) else {}, rest, value)}


def merge(base: dict, over: dict) -> dict:
    """Objects are merged, all else is replaced; ``None`` leaves the base."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(base.get(key), dict)
        out[key] = merge(base[key], value) if both else base.get(key) if value is None else value
    return out


def lift(options: dict, renames: dict[str, str]) -> tuple[dict, list[str]]:
    """Move old names to new ones; (options, names that clash with a different value)."""
    out, clashes = options, []
    for old, new in renames.items():
        value = get(options, old)
        if value is None:
            continue
        now = get(out, new)
        if now is not None and now != value:
            clashes.append(old)
        elif now is None:
            out = put(out, new, value)
    return out, clashes
