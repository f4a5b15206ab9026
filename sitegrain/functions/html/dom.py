"""A small document tree over the scanner, CSS selection, and text.

The builder is tolerant, not a standard tree constructor: preamble before the
first element is dropped, fragments get a document around them, end tags close
the nearest open element of their name, and a few start tags imply end tags.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from . import scanner

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
_ENDS_P = frozenset("address article aside blockquote div dl figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_CLOSED_BY = {name: _CLOSES.get(name, set()) | ({"p"} if name in _ENDS_P else set()) for name in _ENDS_P | set(_CLOSES)}
_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}


class Node:
    """An element; text children are plain strings."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children, self.parent = name, attrs or {}, [], None

    def add(self, child: Node | str) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
                return
        else:
            child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Node]:
        """Descendant elements in document order, without recursion."""
        stack = [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if not isinstance(c, str)]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def html(self) -> str:
        out: list[str] = []
        stack: list[Node | str | tuple[str]] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out.append(node[0])
            elif isinstance(node, str):
                out.append(node.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            else:
                own = "".join([f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in node.attrs.items()]) if node.attrs else ""
                out.append(f"<{node.name}{own}>")
                if node.name in VOID:
                    continue
                if node.name in scanner.RAW and node.name not in ("title", "textarea"):
                    out.append(node.text() + f"</{node.name}>")
                    continue
                stack.append((f"</{node.name}>",))
                stack += reversed(node.children)
        return "".join(out)


#: Comments and declarations between tags, which are no text.
_UNSEEN = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<![A-Za-z][^>]*>|<\?[^>]*>")


def parse(text: str) -> Node:
    """The document's ``html`` element, always with a ``body``."""
    root, head, body = Node("html"), None, None
    stack: list[Node] = [root]
    at = next((t.start for t in scanner.tags(text) if not t.closing and t.name in ("html", "head", "body")), 0)

    def put_text(chunk: str) -> None:
        nonlocal body
        if chunk and (len(stack) > 1 or chunk.strip()):
            if len(stack) == 1:
                if body is None:
                    body = Node("body")
                    root.add(body)
                stack.append(body)
            stack[-1].add(scanner.unescape(chunk))

    def put_markup(lo: int, hi: int) -> None:
        put_text(_UNSEEN.sub("", text[lo:hi]) if text.find("<", lo, hi) >= 0 else text[lo:hi])

    for tag in scanner.tags(text, at):
        if at < tag.start:
            put_markup(at, tag.start)
        at = tag.outer
        name = tag.name
        if tag.closing:
            if name in ("html", "body"):
                continue
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), None)
            if depth is not None:
                del stack[depth:]
            continue
        attrs = {k: scanner.unescape(v) for k, v in scanner.attributes(tag).items()}
        if name == "html":
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            continue
        if name == "head":
            if head is None and body is None:
                head = Node("head", attrs)
                root.add(head)
                stack.append(head)
            continue
        if name == "body":
            if body is None:
                body = Node("body", attrs)
                root.add(body)
                stack[1:] = [body]
            continue
        if len(stack) > 1 and stack[1] is head and name not in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
            del stack[1:]
        if len(stack) == 1:
            if body is None:
                body = Node("body")
                root.add(body)
            stack.append(body)
        closes = _CLOSED_BY.get(name)
        for k in range(len(stack) - 1, 0, -1) if closes else ():
            if stack[k].name in _SCOPE.get(name, ()) or (stack[k].name in ("table", "td", "th") and name == "p"):
                break
            if stack[k].name in closes:
                del stack[k:]
        node = Node(name, attrs)
        stack[-1].add(node)
        if name in scanner.RAW:
            raw = text[tag.end : tag.inner]
            if raw:
                node.add(scanner.unescape(raw) if name in ("title", "textarea") else raw)
        elif name not in VOID and not tag.rest.rstrip().endswith("/"):
            stack.append(node)
    put_markup(at, len(text))
    if body is None:
        root.add(Node("body"))
    return root


def body_of(root: Node) -> Node:
    return next(c for c in root.children if not isinstance(c, str) and c.name == "body")


# -- selectors -----------------------------------------------------------------

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]"""
    r"""|:not\((?P<not>[^()]*)\)|:(?P<pseudo>first-child|last-child|empty)"""
)
_OPS: dict[str, Callable[[str, str], bool]] = {
    "=": lambda a, b: a == b,
    "~=": lambda a, b: b in a.split(),
    "|=": lambda a, b: a == b or a.startswith(b + "-"),
    "^=": lambda a, b: bool(b) and a.startswith(b),
    "$=": lambda a, b: bool(b) and a.endswith(b),
    "*=": lambda a, b: bool(b) and b in a,
}


def _compound(text: str) -> Callable[[Node], bool]:
    tests: list[Callable[[Node], bool]] = []
    at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m:
            raise ValueError(f"unsupported selector: {text!r}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                tests.append(lambda n, t=m["tag"].lower(): n.name == t)
        elif m["id"]:
            tests.append(lambda n, v=m["id"]: n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=m["cls"]: v in n.attrs.get("class", "").split())
        elif m["attr"]:
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), None)
            if m["op"]:
                tests.append(lambda n, a=m["attr"].lower(), v=value, op=_OPS[m["op"]]: a in n.attrs and op(n.attrs[a], v))
            else:
                tests.append(lambda n, a=m["attr"].lower(): a in n.attrs)
        elif m["not"] is not None:
            tests.append(lambda n, s=selector(m["not"]): not s(n))
        else:
            def place(n: Node, which: str = m["pseudo"]) -> bool:
                if which == "empty":
                    return not n.children
                peers = [c for c in n.parent.children if not isinstance(c, str)] if n.parent else [n]
                return peers[0 if which == "first-child" else -1] is n
            tests.append(place)
    if not tests and text != "*":
        raise ValueError("empty selector")
    return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)


def _complex(text: str) -> Callable[[Node], bool]:
    token = r"[>+~]|(?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+"
    parts = re.findall(token, text.strip())
    if not parts or parts[-1] in ">+~" or re.sub(token, "", text).strip():
        raise ValueError(f"unsupported selector: {text!r}")
    chain: list[tuple[str, Callable[[Node], bool]]] = []
    link = " "
    for p in parts:
        if p in (">", "+", "~"):
            link = p
        else:
            chain.append((link, _compound(p)))
            link = " "

    def up(node: Node, k: int) -> bool:
        if k == 0:
            return True
        how, test = chain[k][0], chain[k - 1][1]
        if how in (" ", ">"):
            near = node.ancestors() if how == " " else iter([node.parent] if node.parent else [])
        else:
            peers = [c for c in node.parent.children if not isinstance(c, str)] if node.parent else [node]
            before = peers[: peers.index(node)][::-1]
            near = iter(before if how == "~" else before[:1])
        return any(test(n) and up(n, k - 1) for n in near)

    last = chain[-1][1]
    return last if len(chain) == 1 else lambda n: last(n) and up(n, len(chain) - 1)


_NAME = re.compile(r"[A-Za-z][\w-]*")


@lru_cache(maxsize=256)
def selector(text: str) -> Callable[[Node], bool]:
    """A test for elements; raises ``ValueError`` for what is no selector."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("empty selector")
    parts = [p.strip() for p in re.split(r",(?![^\[(]*[\])])", text)]
    names = frozenset(p.lower() for p in parts if _NAME.fullmatch(p))
    tests = [_complex(p) for p in parts if not _NAME.fullmatch(p)]
    if not tests:
        return lambda n: n.name in names
    return lambda n: n.name in names or any([t(n) for t in tests])


def select(root: Node, text: str, itself: bool = False) -> list[Node]:
    test = selector(text)
    return [n for n in ([root] if itself else []) + list(root.elements()) if test(n)]


# -- plain text ----------------------------------------------------------------

_SILENT = frozenset(("script", "style", "noscript", "template", "iframe"))
_SPACED = (BLOCK - {"body", "html", "fieldset", "form", "tbody", "thead", "tfoot", "td", "th"}) | {"br"}


def plain_text(root: Node) -> str:
    """Text of the body, white space collapsed; blocks end with a blank."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(body_of(root).children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.name not in _SILENT:
            if node.name in _SPACED:
                stack.append(" ")
            stack += reversed(node.children)
    return re.sub(r"[\s﻿]+", " ", "".join(out)).strip()
