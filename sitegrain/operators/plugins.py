"""User code around the pipeline: stages over DataFrames, renderers over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

STAGES = ("discovered", "extract", "transform", "metadata", "graph:build", "artifact:generate", "artifact:validate", "build:complete")


class StageError(ValueError):
    """A stage returned something other than its input's columns."""


@dataclass
class Plugin:
    """Named stage functions, each DataFrame -> DataFrame."""

    name: str
    stages: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if unknown := set(self.stages) - set(STAGES):
            raise ValueError(f"unknown stages {sorted(unknown)}")


@dataclass
class Dispatcher:
    """Runs a stage's functions in order.

    A function that raises, or whose result lacks a column or changes its type, is
    isolated: its input goes on, and ``findings`` has (plugin, stage, code), never
    its message.
    """

    plugins: Sequence[Plugin]
    findings: list[tuple[str, str, str]] = field(default_factory=list)

    def run(self, stage: str, df: DataFrame) -> DataFrame:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        for plugin in self.plugins:
            if stage not in plugin.stages:
                continue
            try:
                out = plugin.stages[stage](df)
                self._check(df, out)
                df = out
            except Exception as error:  # a plugin must not stop the others
                self.findings.append((plugin.name, stage, "plugin-invalid-result" if isinstance(error, StageError) else "plugin-failed"))
        return df

    @staticmethod
    def _check(before: DataFrame, after: DataFrame) -> None:
        if not isinstance(after, DataFrame):
            raise StageError("not a DataFrame")
        have = {f.name: f.dataType for f in after.schema.fields}
        for f in before.schema.fields:
            if have.get(f.name) != f.dataType:
                raise StageError(f.name)


class Renderer(Protocol):
    """Turns a page into Markdown, or says that it does not.

    ``render`` gets a dict of the row and returns a dict with ``status``: rendered
    (and ``markdown``), decline, continue, or fallback-to-html.
    """

    name: str
    api_version: int

    def render(self, page: dict) -> dict: ...


def check_renderer(value: Any) -> None:
    if not getattr(value, "name", "") or getattr(value, "api_version", None) != 1 or not callable(getattr(value, "render", None)):
        raise ValueError("a renderer has a name, api_version 1 and render()")


def ordered(renderers: Sequence[Renderer]) -> list[Renderer]:
    """Renderers of MDX first, the others as they are."""
    return sorted(renderers, key=lambda r: r.name != "mdx")


RENDERED = T.StructType([T.StructField(k, T.StringType()) for k in ("markdown", "renderer", "status", "codes")])


def render_chain(page: dict, renderers: Sequence[Renderer]) -> dict:
    """The first result that renders; failures are codes and the next has its turn."""
    codes = []
    for r in renderers:
        try:
            got = r.render(page)
            status = got.get("status")
        except Exception:
            codes.append("renderer-failed")
            continue
        if isinstance(got.get("code"), str):
            codes.append(got["code"])
        if status == "rendered" and isinstance(got.get("markdown"), str):
            return {"markdown": got["markdown"], "renderer": r.name, "status": "rendered", "codes": ",".join(codes)}
        if status == "fallback-to-html":
            return {"markdown": None, "renderer": r.name, "status": status, "codes": ",".join(codes)}
        if status not in ("decline", "continue"):
            codes.append("renderer-invalid-result")
    return {"markdown": None, "renderer": None, "status": "decline", "codes": ",".join(codes)}


def render(df: DataFrame, renderers: Sequence[Renderer], out: str = "rendered") -> DataFrame:
    """Add what the renderers make of each row, as a struct."""
    for r in renderers:
        check_renderer(r)
    chain = ordered(renderers)
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, RENDERED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(f.name, pa.string()) for f in RENDERED.fields])
        for batch in batches:
            values = [render_chain(row, chain) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


class DensityRenderer:
    """Main content by text density: the element with the most text outside links."""

    name, api_version = "density", 1

    def __init__(self, least: int = 200):
        self.least = least

    def render(self, page: dict) -> dict:
        from ..functions.html import dom, markdown

        root = dom.parse(page.get("html") or "")
        best, top = 0, None
        for node in root.elements():
            if node.name in ("div", "section", "article", "main", "td"):
                own = sum(len(c.text()) for c in node.children if not isinstance(c, str) and c.name in ("p", "pre", "ul", "ol", "blockquote"))
                links = sum(len(a.text()) for a in node.elements() if a.name == "a")
                if own - 2 * links > best:
                    best, top = own - 2 * links, node
        if top is None or best < self.least:
            return {"status": "decline"}
        markdown.clean(top, markdown.Options())
        return {"status": "rendered", "markdown": markdown.to_markdown(top)}


class MdxRenderer:
    """Markdown of MDX sources without running them.

    Module code and comments go; a component is unwrapped, left out, or written as
    another element, as ``components`` maps it (``{"Box": {"action": "unwrap"}}``; ``omit``
    and ``elements`` are short for that).  A source with expressions, or with
    components that nothing is said of, falls back to HTML; one that is no MDX, or
    mappings that are none, leave the page to the next renderer with a code.
    """

    name, api_version = "mdx", 1

    def __init__(self, omit: Sequence[str] = (), elements: dict[str, str] | None = None, components: dict | None = None, unknown: str = "fallback"):
        short = {n: {"action": "omit"} for n in omit} | {n: {"action": "element", "name": e} for n, e in (elements or {}).items()}
        self.components = components if components is not None and not isinstance(components, dict) else short | (components or {})
        self.unknown = unknown

    def render(self, page: dict) -> dict:
        from ..functions import mdx

        if page.get("kind") != "mdx" or not isinstance(page.get("body"), str):
            return {"status": "decline"}
        try:
            known = mdx.mappings(self.components)
        except ValueError:
            return {"status": "continue", "code": "mdx-invalid-component-mapping"}
        try:
            found = mdx.edits(page["body"], known, self.unknown)
        except mdx.MdxError:
            return {"status": "continue", "code": "mdx-parse-failed"}
        if found is None:
            return {"status": "fallback-to-html", "code": "mdx-rendered-html-fallback"}
        text = page["body"]
        for start, stop, put in reversed(found):
            text = text[:start] + put + text[stop:]
        return {"status": "rendered", "markdown": text}


#: Origin that relative addresses get while a renderer needs whole ones.
ORIGIN = "https://sitegrain.invalid/"


class SyntheticOrigin:
    """A renderer that needs absolute addresses, given a page of a made-up origin.

    Markdown comes back with root-relative addresses; those of real origins stay.
    """

    api_version = 1

    def __init__(self, inner: Renderer):
        self.inner, self.name = inner, inner.name

    def render(self, page: dict) -> dict:
        from ..functions import paths

        address = paths.stable_canonical(page.get("pathname") or "/", ORIGIN) or ORIGIN
        got = self.inner.render({**page, "url": page.get("url") or address})
        if isinstance(got, dict) and isinstance(got.get("markdown"), str):
            got = {**got, "markdown": got["markdown"].replace(ORIGIN, "/")}
        return got
