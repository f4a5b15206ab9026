"""Tags of an HTML text by position, and edits that leave all else as it was.

One regular expression reads a comment or a tag; elements whose content is raw
text are skipped to their end tag, so nothing in a script is taken for a tag.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

RAW = frozenset(("script", "style", "template", "noscript", "title", "textarea"))
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<\s*(?P<close>/?)\s*(?P<name>[A-Za-z][A-Za-z\d:-]*)\b(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*(?P<name>[^\s=/>]+)(?:\s*=\s*(?:"(?P<double>[^"]*)"?|'(?P<single>[^']*)'?|(?P<bare>[^\s>]*)))?""", re.S)


_RAW_ENDS = {name: re.compile(rf"</\s*{name}\s*>", re.I) for name in RAW}


class Tag(NamedTuple):
    """A tag: ``start`` to ``end``; its element's raw content to ``inner``, all to ``outer``."""

    name: str
    closing: bool
    start: int
    end: int
    inner: int
    outer: int
    rest: str


def tags(text: str, lo: int = 0, hi: int | None = None) -> Iterator[Tag]:
    """Tags in order; an unclosed raw element runs to the end."""
    hi = len(text) if hi is None else hi
    at = lo
    while m := _TOKEN.search(text, at, hi):
        at = m.end()
        if m["name"] is None:
            continue
        name, closing = m["name"].lower(), bool(m["close"])
        inner = outer = at
        if name in RAW and not closing and not m["rest"].rstrip().endswith("/"):
            end = _RAW_ENDS[name].search(text, at, hi)
            inner, outer = (end.start(), end.end()) if end else (hi, hi)
        yield Tag(name, closing, m.start(), m.end(), inner, outer, m["rest"])
        at = outer


def attributes(tag: Tag) -> dict[str, str]:
    """Attributes by lower-case name, the first of each; one without a value is empty."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag.rest):
        out.setdefault(m["name"].lower(), "" if m.lastgroup == "name" else m[m.lastgroup])
    return out


def head_bounds(text: str) -> tuple[int, int] | None:
    """Where the content of ``<head>`` starts and ends."""
    start = None
    for tag in tags(text):
        if tag.name == "head" and not tag.closing and start is None:
            start = tag.end
        elif tag.name == "head" and tag.closing and start is not None:
            return start, tag.start
    return None


def head_tags(text: str, name: str | None = None) -> list[tuple[Tag, dict[str, str]]]:
    """Opening tags in the head with their attributes."""
    bounds = head_bounds(text)
    if bounds is None:
        return []
    return [(t, attributes(t)) for t in tags(text, *bounds) if not t.closing and name in (None, t.name)]


def cut(text: str, spans: list[tuple[int, int]], put: str = "") -> str:
    """Replace spans, from the last to the first."""
    for start, end in sorted(spans, reverse=True):
        text = text[:start] + put + text[end:]
    return text


def remove_head_tags(text: str, name: str, test: Callable[[dict], bool], whole: bool = False) -> str:
    return cut(text, [(t.start, t.outer if whole else t.end) for t, a in head_tags(text, name) if test(a)])


def replace_head_tag(text: str, name: str, test: Callable[[dict], bool], put: str) -> str:
    found = next((t for t, a in head_tags(text, name) if test(a)), None)
    return cut(text, [(found.start, found.end)], put) if found else text


def insert_into_head(text: str, addition: str) -> str:
    bounds = head_bounds(text)
    return text if bounds is None or not addition else text[: bounds[1]] + addition + text[bounds[1] :]


def remove_elements(text: str, name: str, test: Callable[[dict, str], bool]) -> str:
    return cut(text, [(t.start, t.outer) for t in tags(text) if not t.closing and t.name == name and test(attributes(t), text[t.end : t.inner])])


# The references that head values may hold, ``&amp;`` last.
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'"), ("&#x27;", "'"), ("&#X27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decode(text: str) -> str:
    for old, new in _NAMED:
        text = text.replace(old, new)
    return text


def decode_attribute(text: str) -> str:
    """The five XML names and numeric references; what is no character stays."""
    names = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}

    def one(m: re.Match) -> str:
        if m[3]:
            return names.get(m[3].lower(), m[0])
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]

    return re.sub(r"&(?:#(\d{1,9})|#[xX]([\da-fA-F]{1,8})|([a-zA-Z]+));", one, text)


def unescape(text: str) -> str:
    return _html.unescape(text)


def head_features(text: str) -> dict:
    """What pages say of themselves in tags; absent values are null.

    A ``<meta>`` that matches first decides, also if it has no content.
    """
    meta: dict[tuple[str, str], str | None] = {}
    out: dict = {"title": "", "lang": None, "refresh": False, "links": [], "metas": [], "scripts": [], "has_head": head_bounds(text) is not None}
    seen_title = False
    for tag in tags(text):
        if tag.closing:
            continue
        if tag.name == "title" and not seen_title:
            seen_title = True
            out["title"] = decode(text[tag.end : tag.inner].strip())
        elif tag.name == "html" and out["lang"] is None:
            out["lang"] = attributes(tag).get("lang")
        elif tag.name == "meta":
            a = attributes(tag)
            value = decode(a["content"]) if "content" in a else None
            out["refresh"] |= a.get("http-equiv", "").lower() == "refresh"
            for kind in ("name", "property"):
                if kind in a:
                    meta.setdefault((kind, a[kind].lower()), value)
            out["metas"].append({"name": a.get("name"), "property": a.get("property"), "content": value})
        elif tag.name == "link":
            a = attributes(tag)
            out["links"].append({k: a.get(k) for k in ("rel", "href", "type", "hreflang")})
        elif tag.name == "script":
            a = attributes(tag)
            if a.get("type", "").lower().strip() == "application/ld+json":
                out["scripts"].append(text[tag.end : tag.inner])

    def first(name: str) -> str | None:
        return meta.get(("name", name))

    out |= {
        "description": first("description"),
        "robots": first("robots"),
        "opt_out": first("aeo"),
        "twitter_card": first("twitter:card"),
        **{k: meta.get(("property", f"og:{k[3:]}")) for k in ("og_title", "og_description", "og_image")},
        "modified": meta.get(("property", "article:modified_time"), meta.get(("name", "article:modified_time"))),
    }
    return out
