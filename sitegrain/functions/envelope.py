"""Two views of a page's graph, and what becomes of both when one is edited.

The *managed* view is what we add to a page, the *whole* view is that merged with
what its authors wrote.  Hooks may edit either; authors' facts are never rewritten.
"""

from __future__ import annotations

from typing import Any

from . import graph as G


#: No difference; JSON has a null of its own.
NOTHING = object()


def _types(value: Any) -> list[str]:
    return [t for t in (value if isinstance(value, list) else [value]) if isinstance(t, str)]


def additions(value: Any, known: Any) -> Any:
    """What ``value`` says beyond ``known``; ``NOTHING`` if nothing.

    Items of a list meet by being equal, each once, then by ``@id``.  An object of
    which something is left keeps its ``@id``, and one type for context; new types
    are what is left of its types.  What is removed or replaced shows when both are
    combined again.
    """
    if G.stable(value) == G.stable(known):
        return NOTHING
    if isinstance(value, list) and isinstance(known, list):
        free = list(range(len(known)))
        out = []
        for item in value:
            at = next((k for k in free if G.stable(known[k]) == G.stable(item)), None)
            if at is not None:
                free.remove(at)
                continue
            name = item.get("@id") if isinstance(item, dict) else None
            at = next((k for k in free if isinstance(name, str) and isinstance(known[k], dict) and known[k].get("@id") == name), None)
            if at is None:
                out.append(item)
                continue
            free.remove(at)
            rest = additions(item, known[at])
            if rest is not NOTHING:
                out.append(rest)
        return out or NOTHING
    if isinstance(value, dict) and isinstance(known, dict):
        out = {}
        for key, item in value.items():
            if key not in ("@id", "@type"):
                rest = item if key not in known else additions(item, known[key])
                if rest is not NOTHING:
                    out[key] = rest
        new = [t for t in _types(value.get("@type")) if t not in _types(known.get("@type"))]
        if not out and not new:
            return NOTHING
        if isinstance(value.get("@id"), str):
            out["@id"] = value["@id"]
        if new:
            out["@type"] = new[0] if len(new) == 1 else new
        elif "@type" in value:
            out["@type"] = (_types(value["@type"]) or [value["@type"]])[0]
        return out
    return value


def _about(e: dict) -> str:
    return G.stable([sorted(e["roles"]), sorted(map(G.stable, e["provenance"]))])


def delta(whole: list[dict], authored: list[dict]) -> list[dict]:
    """The managed entries that make ``whole`` of ``authored``, as far as additions can."""
    named = {e["entity"]["@id"]: e for e in authored if isinstance(e["entity"].get("@id"), str)}
    nameless = [e for e in authored if not isinstance(e["entity"].get("@id"), str)]
    out = []
    for e in whole:
        name = e["entity"].get("@id")
        if not isinstance(name, str):
            at = next((k for k, a in enumerate(nameless) if G.stable(a["entity"]) == G.stable(e["entity"])), None)
            if at is None or _about(nameless.pop(at)) != _about(e):
                out.append(e)
            continue
        own = named.get(name)
        if own is None:
            out.append(e)
            continue
        rest = additions(e["entity"], own["entity"])
        if rest is NOTHING and _about(own) == _about(e):
            continue
        bare = {"@id": name} | ({"@type": _types(e["entity"]["@type"])[0]} if _types(e["entity"].get("@type")) else {})
        out.append(e | {"entity": bare if rest is NOTHING else rest})
    return out


def combine(authored: list[dict], managed: list[dict]) -> list[dict] | None:
    """The whole view; null if the two contradict each other."""
    merged = G.merge([authored, managed])
    return None if any(c["resolution"] == "unresolved" for c in merged.conflicts) else merged.entries


class Conflict(ValueError):
    """An addition that contradicts what is there."""


def added(current: Any, more: Any) -> Any:
    """``current`` with the facts of ``more``; ``Conflict`` where it says otherwise."""
    if G.stable(current) == G.stable(more):
        return current
    if isinstance(current, list) and isinstance(more, list):
        out = list(current)
        for item in more:
            if any(G.stable(x) == G.stable(item) for x in out):
                continue
            name = item.get("@id") if isinstance(item, dict) else None
            at = next((k for k, x in enumerate(out) if name is not None and isinstance(x, dict) and x.get("@id") == name), None)
            if at is None:
                out.append(item)
            else:
                out[at] = added(out[at], item)
        return out
    if isinstance(current, dict) and isinstance(more, dict):
        return current | {k: added(current[k], v) if k in current else v for k, v in more.items()}
    raise Conflict(G.stable(more))


def reconcile(authored: list[dict], managed: list[dict], whole: list[dict], new_managed: list[dict], new_whole: list[dict]) -> tuple[list[dict], list[dict], bool, bool, str | None]:
    """(managed, whole, managed changed, whole changed, error code) after an edit of either view.

    One changed view decides about the other; two changed ones have to agree.  With an
    error both are as they were.
    """
    first, second = not G.same(managed, new_managed), not G.same(whole, new_whole)
    if not first and not second:
        return managed, whole, False, False, None
    mine = new_managed if first else delta(new_whole, authored)
    both = combine(authored, mine)
    if both is None:
        return managed, whole, first, second, "managed-graph-invalid"
    if second and not G.same(new_whole, both):
        return managed, whole, first, second, "managed-graph-inconsistent" if first else "managed-graph-not-additive"
    return mine, both, first, second, None
