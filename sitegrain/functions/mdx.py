"""Reading MDX without running it: a lexer, a tree of what is no Markdown, and edits.

Only module code, expressions in braces and JSX tags are looked for; Markdown between
them stays byte for byte.  Nothing is evaluated: an expression that is more than a
comment makes the source unusable as Markdown.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Elements that never come out, and names that are plain elements.
NEVER = frozenset(("script", "style", "iframe", "object", "embed"))
PLAIN = re.compile(r"[a-z][a-z0-9-]*\Z")
_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})[^\n]*(?:\n|\Z)")
_MODULE = re.compile(r"(?:import|export)\b(?=[\s{*'\"])")
_BLANK = re.compile(r"[ \t]*(?:\n|\Z)")
_OPEN, _CLOSE = "([{", ")]}"


class MdxError(ValueError):
    """A source that is no MDX."""


@dataclass
class Node:
    """Module code, an expression or an element: ``start`` to ``stop``, its tags' inner ends."""

    kind: str
    start: int
    stop: int = -1
    name: str | None = None
    literal: bool = True
    opened: int = -1
    closing: int = -1
    children: list[Node] = field(default_factory=list)


def _string(text: str, at: int) -> int:
    """After the string, template or comment that starts here, or ``at`` if none does."""
    if text[at] in "'\"":
        m = re.compile(r"(['\"])(?:\\.|(?!\1)[^\\\n])*\1", re.S).match(text, at)
        if not m:
            raise MdxError("unclosed string")
        return m.end()
    if text[at] == "`":
        k = at + 1
        while k < len(text):
            if text[k] == "\\":
                k += 2
            elif text[k] == "`":
                return k + 1
            elif text.startswith("${", k):
                k = braces(text, k + 1)
            else:
                k += 1
        raise MdxError("unclosed template")
    if text.startswith("//", at):
        end = text.find("\n", at)
        return len(text) if end < 0 else end
    if text.startswith("/*", at):
        end = text.find("*/", at + 2)
        if end < 0:
            raise MdxError("unclosed comment")
        return end + 2
    return at


def braces(text: str, at: int) -> int:
    """After the brace that closes the one at ``at``; strings and comments are passed over."""
    depth = []
    while at < len(text):
        past = _string(text, at)
        if past > at:
            at = past
            continue
        if text[at] in _OPEN:
            depth.append(_CLOSE[_OPEN.index(text[at])])
        elif text[at] in _CLOSE:
            if not depth or depth.pop() != text[at]:
                raise MdxError("unbalanced braces")
            if not depth:
                return at + 1
        at += 1
    raise MdxError("unclosed brace")


def _module(text: str, at: int) -> int:
    """After a block of imports and exports: a blank line where all brackets are closed."""
    depth: list[str] = []
    while at < len(text):
        if text[at] == "\n" and not depth:
            if _BLANK.match(text, at + 1):
                return at + 1
            if not _MODULE.match(text, at + 1) and not re.match(r"[ \t}\])]", text[at + 1]):
                raise MdxError("module code ends in a blank line")
        past = _string(text, at)
        if past > at:
            at = past
            continue
        if text[at] in _OPEN:
            depth.append(_CLOSE[_OPEN.index(text[at])])
        elif text[at] in _CLOSE and (not depth or depth.pop() != text[at]):
            raise MdxError("unbalanced brackets")
        at += 1
    if depth:
        raise MdxError("unclosed bracket")
    return at


def _tag(text: str, at: int) -> tuple[bool, str | None, bool, bool, int]:
    """(closing, name, literal attributes, self-closing, end) of the tag at ``at``."""
    k = at + 1
    closing = text.startswith("/", k)
    k += closing
    space = re.compile(r"\s*")
    k = space.match(text, k).end()
    m = _NAME.match(text, k)
    name, k = (m[0], m.end()) if m else (None, k)
    literal = True
    while True:
        k = space.match(text, k).end()
        if k >= len(text):
            raise MdxError("unclosed tag")
        if text[k] == ">":
            return closing, name, literal, False, k + 1
        if text.startswith("/", k):
            k = space.match(text, k + 1).end()
            if not text.startswith(">", k) or closing:
                raise MdxError("stray slash")
            return closing, name, literal, True, k + 1
        if name is None or closing:
            raise MdxError("no tag")
        if text[k] == "{":
            literal, k = False, braces(text, k)
            continue
        m = _NAME.match(text, k)
        if not m:
            raise MdxError("no attribute")
        k = space.match(text, m.end()).end()
        if text.startswith("=", k):
            k = space.match(text, k + 1).end()
            if text.startswith("{", k):
                literal, k = False, braces(text, k)
            elif text[k : k + 1] in ("'", '"') and (end := text.find(text[k], k + 1)) > 0:
                k = end + 1
            else:
                raise MdxError("no attribute value")


def parse(text: str) -> list[Node]:
    """The top nodes of a source; ``MdxError`` where it is no MDX."""
    top = Node("root", 0)
    stack = [top]
    at, fresh = 0, True  # fresh: at the start of a block
    while at < len(text):
        starts = at == 0 or text[at - 1] == "\n"
        if starts:
            if fresh and len(stack) == 1 and _MODULE.match(text, at):
                end = _module(text, at)
                top.children.append(Node("module", at, end))
                at = end
                continue
            if fence := _FENCE.match(text, at):
                close = re.compile(rf"^[ \t]*{fence[1][0]}{{{len(fence[1])},}}[ \t]*$", re.M).search(text, fence.end())
                at = close.end() if close else len(text)
                fresh = False
                continue
            fresh = bool(_BLANK.match(text, at))
        char = text[at]
        if char == "\\":
            at += 2
        elif char == "`":
            run = re.compile("`+").match(text, at)
            close = re.compile(rf"(?<!`){run[0]}(?!`)").search(text, run.end())
            at = close.end() if close else run.end()
        elif char == "{":
            end = braces(text, at)
            stack[-1].children.append(Node("expression", at, end))
            at = end
        elif char == "<":
            if not re.match(r"[A-Za-z_$>/]", text[at + 1 : at + 2]):
                raise MdxError("no tag")
            closing, name, literal, alone, end = _tag(text, at)
            if closing:
                if len(stack) == 1 or stack[-1].name != name:
                    raise MdxError("closing tag of another element")
                node = stack.pop()
                node.closing, node.stop = at, end
            else:
                node = Node("element", at, end if alone else -1, name, literal, end)
                stack[-1].children.append(node)
                if not alone:
                    stack.append(node)
            at = end
        else:
            at += 1
    if len(stack) > 1:
        raise MdxError("unclosed element")
    return top.children


def mappings(components: object) -> dict[str, tuple[str, str | None]]:
    """Checked mappings: component -> (unwrap, omit or element; its name); ``ValueError`` for others."""
    out: dict[str, tuple[str, str | None]] = {}
    if components is None:
        return out
    if not isinstance(components, dict):
        raise ValueError("components are an object")
    for name, how in components.items():
        if not name or not isinstance(name, str) or not isinstance(how, dict):
            raise ValueError(f"no mapping: {name!r}")
        action, to = how.get("action"), how.get("name")
        if action in ("unwrap", "omit") and set(how) == {"action"}:
            out[name] = (action, None)
        elif action == "element" and set(how) == {"action", "name"} and isinstance(to, str) and PLAIN.match(to) and to not in NEVER:
            out[name] = (action, to)
        else:
            raise ValueError(f"no mapping: {name!r}")
    return out


def edits(text: str, components: dict[str, tuple[str, str | None]], unknown: str = "fallback") -> list[tuple[int, int, str]] | None:
    """Edits that leave Markdown and plain elements; null if the source needs to be run for that.

    Components without a mapping are as ``unknown`` says: fallback or unwrap.
    """
    out: list[tuple[int, int, str]] = []
    todo = parse(text)[::-1]
    while todo:
        node = todo.pop()
        if node.kind == "module":
            out.append((node.start, node.stop, ""))
            continue
        if node.kind == "expression":
            if not re.fullmatch(r"\{\s*(?:/\*(?:(?!\*/).)*\*/\s*)+\}", text[node.start : node.stop], re.S):
                return None
            out.append((node.start, node.stop, ""))
            continue
        if node.name in NEVER:
            out.append((node.start, node.stop, ""))
            continue
        if not node.literal:
            return None
        how = ("unwrap", None) if node.name is None else components.get(node.name)
        if how is None and not PLAIN.match(node.name):
            if unknown == "fallback":
                return None
            how = ("unwrap", None)
        if how is not None:
            action, to = how
            if action == "omit":
                out.append((node.start, node.stop, ""))
                continue
            start, end = (f"<{to}>", f"</{to}>") if to else ("", "")
            if node.closing < 0:
                out.append((node.start, node.stop, start + end))
            else:
                out += [(node.start, node.opened, start), (node.closing, node.stop, end)]
        todo += node.children[::-1]
    return sorted(out)
