"""Declared shapes of JSON values, compiled to one column that finds the first fault.

A shape is a tree of :func:`text`, :func:`flag`, :func:`number`, :func:`one_of`,
:func:`array`, :func:`record`, :func:`either`.  :func:`fault` compiles it to a column
over a ``variant``: the JSON pointer of what is wrong first, in the order in which the
shape is declared, or null.  Nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths, text as T


@dataclass(frozen=True)
class Shape:
    """``kind`` is text, flag, number, array, record, either or any; the rest as the makers say."""

    kind: str
    test: Callable[[Column], Column] | None = None
    of: tuple = ()
    fields: dict = field(default_factory=dict)
    required: frozenset = frozenset()


def text(test: Callable[[Column], Column] | None = None) -> Shape:
    """A string; ``test`` gets it as a column."""
    return Shape("text", test)


def flag() -> Shape:
    return Shape("flag")


def number() -> Shape:
    return Shape("number")


def one_of(*values: str) -> Shape:
    return Shape("text", lambda c: c.isin(*values))


def array(of: Shape) -> Shape:
    return Shape("array", of=(of,))


def record(required: tuple[str, ...] = (), **fields: Shape) -> Shape:
    """An object; what is not among ``fields`` is not looked at."""
    return Shape("record", fields=fields, required=frozenset(required))


def either(*shapes: Shape) -> Shape:
    """Any of the shapes; a fault is that of the value itself."""
    return Shape("either", of=shapes)


def member(value: Column, key: str) -> Column:
    """A member of an object as a variant; SQL null if there is none (JSON's null is a value)."""
    return F.try_variant_get(value, "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """The string that a variant is; null for any other value."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _bad(shape: Shape, value: Column, pointer: Column) -> Column:
    """Pointer of the first fault in a value that is there, else null."""
    kind = _kind(value)
    wrong = lambda ok: F.when(~F.coalesce(ok, F.lit(False)), pointer)
    if shape.kind == "text":
        ok = kind == "STRING"
        return wrong(ok if shape.test is None else ok & shape.test(F.try_variant_get(value, "$", "string")))
    if shape.kind == "flag":
        return wrong(kind == "BOOLEAN")
    if shape.kind == "number":
        return wrong(kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    if shape.kind == "array":
        # Items of one type have that type in the schema; of any, it is named variant.
        items = F.try_variant_get(value, "$", "array<variant>")
        found = F.filter(F.transform(items, lambda v, k: _bad(shape.of[0], v, F.concat(pointer, F.lit("/"), k.cast("string")))), lambda p: p.isNotNull())
        return F.coalesce(wrong(kind.startswith("ARRAY")), F.get(found, F.lit(0)))
    if shape.kind == "either":
        return F.when(~F.greatest(*[F.coalesce(_bad(s, value, pointer).isNull(), F.lit(False)) for s in shape.of], F.lit(False)), pointer)
    if shape.kind == "record":
        found = [wrong(kind.startswith("OBJECT"))]
        for key, inner in shape.fields.items():
            child = member(value, key)
            place = F.concat(pointer, F.lit("/" + key.replace("~", "~0").replace("/", "~1")))
            there = _bad(inner, child, place)
            found.append(F.when(child.isNull(), place if key in shape.required else F.lit(None).cast("string")).otherwise(there))
        return F.coalesce(*found)
    return F.lit(None).cast("string")


def fault(shape: Shape, value: Column) -> Column:
    """Pointer of the first fault of a variant ('' is the value itself), null if there is none.

    SQL null, as of JSON that could not be parsed, is a fault of the value itself.
    """
    return F.when(value.isNull(), F.lit("")).otherwise(_bad(shape, value, F.lit("")))


def parsed(json: Column) -> Column:
    """A variant of a JSON text; null for what is none."""
    return F.try_parse_json(json)


# -- shapes of the pipeline ----------------------------------------------------

_DATE = text(lambda c: T.is_full_date(c) | T.is_rfc3339(c))
_NAME = text(lambda c: (c != "") & ~c.rlike(r"[\x00-\x1f\x7f]"))
_TYPE = either(_NAME, array(_NAME))
ENTITY = Shape("record", fields={"@id": _NAME, "@type": _TYPE}, required=frozenset(("@type",)))
REFERENCE = either(_NAME, Shape("record", fields={"@id": _NAME}, required=frozenset(("@id",))), ENTITY)
# Fixed values of the page model.
RENDERINGS = ("prerendered", "on-demand")
SOURCE_KINDS = ("markdown", "mdx", "astro", "cms", "rendered", "custom")
SEVERITIES = ("info", "warning", "error")
_DIRECTIVES = {k: flag() for k in ("index", "includeInLlms", "includeInLlmsFull", "generateMarkdown")}

DESCRIPTOR = record(
    ("pathname",),
    pathname=text(lambda c: paths.catalog_path_column(c).isNotNull()), routePattern=text(), rendering=one_of(*RENDERINGS), title=text(), description=text(), image=text(), language=text(), markdown=text(), sourcePath=text(),
    dates=record(published=_DATE, modified=_DATE), lastModified=_DATE, authors=array(REFERENCE), entities=array(ENTITY), directives=record(**_DIRECTIVES), source=record(("kind",), kind=one_of(*SOURCE_KINDS), path=text(), body=text()),
)
METADATA = record(("title",), title=text(), description=text(), image=text(), canonicalSource=one_of("authored", "inferred"))
DIAGNOSTIC = record(("code", "severity", "message"), code=_NAME, severity=one_of(*SEVERITIES), message=text(), pathname=text())
RECORD = record(
    ("id", "pathname", "url", "mdHref", "markdown", "rendering", "metadata", "directives", "aeoTokens", "diagnostics"),
    id=_NAME, pathname=text(lambda c: paths.catalog_path_column(c).isNotNull()), url=_NAME, mdHref=text(lambda c: c.startswith("/") & c.endswith(".md")), markdown=text(), rendering=one_of(*RENDERINGS), language=text(),
    metadata=METADATA, dates=record(published=_DATE, modified=_DATE), authors=array(REFERENCE), entities=array(ENTITY), directives=Shape("record", fields=_DIRECTIVES, required=frozenset(_DIRECTIVES)), aeoTokens=array(_NAME), diagnostics=array(DIAGNOSTIC),
)
CLAIM = record(("claimId", "pathname"), claimId=_NAME, pathname=text(lambda c: paths.catalog_path_column(c).isNotNull()), replace=flag(), contentType=text(lambda c: c.rlike(r"^[\w!#$&^.+-]+/[\w!#$&^.+-]+(\s*;.*)?$")), group=_NAME)
