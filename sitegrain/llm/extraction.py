"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read once, tag by tag, with the stack of open elements.  Text between two
block-level tags is a leaf block; a block's features are the tags, classes, ids and
roles of its ancestors and the look of its text.  A chain of two labels, main text
or not, with transitions that depend on whether a block stands in the same element
as the one before it, is trained on labelled pages and decoded by Viterbi.  Blocks
told to be main text are joined by an empty line.

Labelled pages are a table of html and its true main text; without one, pages that
:mod:`pagemaker` lays out at random are used, ``LABELLED`` of them.  The model is
some thousand weights, sent to the tasks with the function.

Odd rows: a null or empty page has an empty text, and so has one without an article.
Repeated pages give equal rows.  A page is read whole, however long; unclosed tags,
stray ends and unclosed comments are read as browsers do, more or less.  Other
columns are passed on; one called like the result is replaced.  An empty table gives
an empty one.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import name, unused

#: Labelled pages that a model is fitted on at most; more than that raises ``ValueError``.
LABELLED = 800
#: Labelled pages that a feature must be on; rarer ones, such as most words, tell nothing.
SUPPORT = 5

# Fixed values of the HTML language.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_RAW = "script|style|template|noscript|textarea|title|iframe|svg|math|object|audio|video|canvas"
_ENDS_P = _BLOCK - frozenset("button option optgroup legend td th tr tbody thead tfoot caption html head body".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody"}, {"table"}),
}
_FRAME = frozenset("article main nav aside header footer form section figure table dialog".split())

_TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:-->|\Z))|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    """A leaf block: its text, features, and whether it stands in the same element as the one before."""

    text: str
    features: tuple[str, ...]
    same: bool


class _Open:
    """An open element: what it and its ancestors give as features."""

    __slots__ = ("features", "frame", "linked", "name")

    def __init__(self, name: str, above: _Open | None, rest: str):
        self.name = name
        own = {"t:" + name}
        for m in _ATTRIBUTE.finditer(rest) if rest else ():
            key, value = m[1].lower(), next((v for v in m.groups()[1:] if v), "").lower()
            if key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    own.add("c:hidden")
            elif key in ("hidden", "aria-hidden"):
                if value != "false":
                    own.add("c:hidden")
            else:  # ``postComments`` and ``post-comments`` have the same words
                words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", next((v for v in m.groups()[1:] if v), "")).replace("_", " "))
                own.update("c:" + w.lower().rstrip("s") for w in words)
        self.features = (above.features if above else frozenset()) | own
        frame = above.frame if above else ("", "")
        self.frame = (frame[1], name) if name in _FRAME else frame
        self.linked = name == "a" or bool(above and above.linked)


def _bucket(value: float, ends: tuple) -> int:
    return sum(value >= e for e in ends)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, each with its features."""
    root = _Open("html", None, "")
    stack, out = [root], []
    parts: list[str] = []
    size = linked = 0
    title_seen = False
    last: _Open | None = None

    def flush() -> None:
        nonlocal size, linked, last, title_seen
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name in _BLOCK), 0)
            own, top = stack[depth], stack[-1]
            above = stack[depth - 1] if depth else root
            words = text.split(" ")
            length, link = _bucket(len(words), (2, 5, 10, 20, 40)), _bucket(linked / max(1, size), (0.01, 0.3, 0.7))
            plain = own.frame[1] or "-"
            title_seen |= own.name == "h1"
            told = {
                f"b:{own.name}", f"u:{above.name}>{own.name}", f"f:{plain}", f"f2:{own.frame[0]}>{own.frame[1]}", f"l:{length}", f"k:{link}", f"lk:{length}{link}", f"bl:{own.name}{length}",
                f"fl:{plain}{length}", f"e:{text[-1] in '.!?…:;”»'}", f"h:{title_seen}", f"fh:{plain}{title_seen}", "one",
            }
            if len(words) <= 40:
                told.update("w:" + w for w in _WORDS.findall(text.lower()))
                if "©" in text or "(c)" in text:
                    told.add("w:©")
            out.append(Block(text, tuple(told | top.features), above is last))
            last = above
        size = linked = 0

    def say(raw: str) -> None:
        nonlocal size, linked
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not text.isspace():
                size += len(text)
                linked += len(text) if stack[-1].linked else 0

    at = 0
    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["name"] or m["name2"]
        if not tag:
            if m["raw"] and not m["raw"].lower().startswith(("script", "style", "template", "noscript", "title")):
                parts.append(" ")
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag in ("body", "html"):
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in _BLOCK:
                flush()
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == tag or (tag not in _BLOCK and stack[k].name in _BLOCK)), 0)
            if depth and stack[depth].name == tag:
                del stack[depth:]
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        del stack[k:]
                        break
                    if stack[k].name in _BLOCK:
                        break
            gone, within = _CLOSES.get(tag, ((), ()))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in within:
                    break
                if stack[k].name in gone:
                    del stack[k:]
                    break
        rest = m["rest"] if m["name"] else m["rest2"]
        if tag in _VOID or tag in ("html", "head") or rest.endswith("/") and tag not in _BLOCK:
            continue
        if tag == "body":
            if len(stack) == 1:
                stack.append(_Open(tag, root, rest))
            continue
        stack.append(_Open(tag, stack[-1], rest))
    say(page[at:])
    flush()
    return out


class Model(NamedTuple):
    """Weights for the label *main text*, and transitions [same element][label before][label]."""

    weights: dict[str, float]
    moves: tuple
    begins: tuple[float, float]


def decode(model: Model, page: list[Block]) -> list[bool]:
    """The most probable labels of a page's blocks, by Viterbi."""
    if not page:
        return []
    weights, moves = model.weights, model.moves
    get = weights.get
    no, yes = model.begins
    back: list[tuple[int, int]] = []
    for k, block in enumerate(page):
        gain = sum([get(f, 0.0) for f in block.features])
        if k:
            m = moves[block.same]
            stay, come = no + m[0][0], yes + m[1][0]
            go, keep = no + m[0][1], yes + m[1][1]
            back.append((int(come > stay), int(keep >= go)))
            no, yes = max(stay, come), max(go, keep)
        yes += gain
    label = int(yes > no)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return [bool(x) for x in reversed(out)]


def labelled_blocks(page: str, text: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page, each true if it is the next of the main text's blocks."""
    found = blocks(page)
    want, labels, at = [b for b in text.split("\n\n") if b], [], 0
    for b in found:
        hit = at < len(want) and b.text == want[at]
        labels.append(hit)
        at += hit
    if at < len(want):
        raise ValueError(f"no block of the page is {want[at][:60]!r}")
    return found, labels


def train(pages: list[tuple[str, str]], rounds: int = 150, decay: float = 2e-4, rate: float = 0.15, limit: int = LABELLED) -> Model:
    """Fit the chain to (html, main text) pairs, ``limit`` at most, by gradient steps on the likelihood.

    Forward and backward sums run over all pages at once.
    """
    if len(pages) > limit:
        raise ValueError(f"{len(pages)} labelled pages; {limit} at most")
    both = [x for x in (labelled_blocks(*p) for p in pages) if x[0]]
    support = Counter(f for found, _ in both for f in {f for b in found for f in b.features})
    names = {f: k for k, f in enumerate(sorted(f for f, n in support.items() if n >= SUPPORT))}
    pages_n, longest = len(both), max(len(f) for f, _ in both)
    size = np.array([len(f) for f, _ in both])
    real = np.arange(longest) < size[:, None]
    truth = np.zeros((pages_n, longest), int)
    same = np.zeros((pages_n, longest), int)
    flat, ends, place = [], [0], []
    for p, (found, labels) in enumerate(both):
        for k, (b, label) in enumerate(zip(found, labels, strict=True)):
            truth[p, k], same[p, k] = label, b.same
            flat += [names[f] for f in b.features if f in names]
            ends.append(len(flat))
            place.append((p, k))
    flat, ends = np.array(flat), np.array(ends)
    at = tuple(np.array(place).T)
    theta = np.zeros(len(names) + 10)  # weights, transitions 2 x 2 x 2, beginnings
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inner = real[:, 1:]
    for step in range(1, rounds + 1):
        w, moves, begins = theta[:-10], theta[-10:-2].reshape(2, 2, 2), theta[-2:]
        score = np.zeros((pages_n, longest, 2))
        score[(*at, 1)] = np.add.reduceat(w[flat], ends[:-1])
        ahead = np.zeros((pages_n, longest, 2))
        ahead[:, 0] = score[:, 0] + begins
        for k in range(1, longest):
            move = ahead[:, k - 1, :, None] + moves[same[:, k]]
            ahead[:, k] = np.where(real[:, k, None], np.logaddexp(move[:, 0], move[:, 1]) + score[:, k], ahead[:, k - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((pages_n, longest, 2))
        for k in range(longest - 2, -1, -1):
            move = moves[same[:, k + 1]] + (score[:, k + 1] + behind[:, k + 1])[:, None, :]
            behind[:, k] = np.where(real[:, k + 1, None], np.logaddexp(move[..., 0], move[..., 1]), 0)
        grad = np.zeros_like(theta)
        likely = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None])
        grad[:-10] = np.bincount(flat, np.repeat((truth - likely)[at], np.diff(ends)), len(names))
        pairs = np.exp(ahead[:, :-1, :, None] + moves[same[:, 1:]] + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None])
        pairs *= inner[..., None, None]
        seen = np.zeros_like(pairs)
        p, k = np.nonzero(inner)
        seen[p, k, truth[p, k], truth[p, k + 1]] = 1
        for kind in (0, 1):
            grad[-10:-2].reshape(2, 2, 2)[kind] = (seen - pairs)[same[:, 1:] == kind].sum(axis=0)
        grad[-2:] = np.bincount(truth[:, 0], minlength=2) - np.exp(ahead[:, 0] + behind[:, 0] - total[:, None]).sum(axis=0)
        grad = grad / pages_n - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    kept = {f: float(theta[k]) for f, k in names.items() if abs(theta[k]) > 1e-3}
    moves = theta[-10:-2].reshape(2, 2, 2)
    return Model(kept, tuple(tuple(tuple(map(float, row)) for row in m) for m in moves), (float(theta[-2]), float(theta[-1])))


@lru_cache(maxsize=1)
def default_model() -> Model:
    from .pagemaker import pages

    return train(pages(LABELLED, seed=11))


def main_text(model: Model, page: str | None) -> str:
    """Blocks of the page that are main text, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, decode(model, found), strict=True) if keep)


def extract(df: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """``df`` with the main text of each page as ``text`` and its code points as ``n_chars``."""
    model = model or default_model()
    kept = [c for c in df.columns if c.lower() not in ("text", "n_chars")]
    fields = df.select(*[name(c) for c in kept]).schema
    schema = fields.add("text", "string").add("n_chars", "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(model, v.as_py()) for v in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    return df.select(*[name(c) for c in kept], name(html).alias(unused("_page", df))).mapInArrow(scan, schema)


def digest(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(pages.select("page_id", "url", F.col("html"))).drop("html")
