"""Content negotiation as pure functions, and header columns."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens, media ranges and quality values as headers may spell them, in ASCII.
_TOKEN = r"[!#$%&'*+.^_`|~A-Za-z0-9\-]+"
_KIND = r"(?:\*/\*|[!#$%&'+.^_`|~A-Za-z0-9\-]+/(?:[!#$%&'+.^_`|~A-Za-z0-9\-]+|\*))"
_QUOTED = r'"(?:[\t !#-\[\]-~\x80-\U0010FFFF]|\\[\t !-~\x80-\U0010FFFF])*"'
_QUALITY = re.compile(r"0(?:\.[0-9]{0,3})?|1(?:\.0{0,3})?")

_PAIR = rf"\s*;\s*(?P<name>{_TOKEN})\s*=\s*(?P<value>{_TOKEN}|{_QUOTED})"
_PAIRS = re.compile(_PAIR, re.S)
_UNNAMED = re.sub(r"\?P<\w+>", "?:", _PAIR)
#: One range with its parameters, up to a comma or the end.
_MEMBER = re.compile(rf"\s*({_KIND})((?:{_UNNAMED})*)\s*(,|\Z)", re.S)


class Range(NamedTuple):
    """A media range of an Accept header."""

    type: str
    parameters: tuple[tuple[str, str], ...]
    q: float


MARKDOWN = ("text/markdown", (("charset", "utf-8"),))
HTML = tuple((t, p) for t in ("text/html", "application/xhtml+xml") for p in ((), (("charset", "utf-8"),)))


def _range(kind: str, given: list[tuple[str, str]]) -> Range | None:
    """A range with its parameters; null if they contradict each other."""
    names = [name.lower() for name, _ in given]
    cut = names.index("q") if "q" in names else len(names)
    own = names[:cut]
    if names.count("q") > 1 or len(set(own)) < len(own):
        return None
    quality = given[cut][1] if cut < len(given) else "1"
    if not _QUALITY.fullmatch(quality):
        return None
    values = (re.sub(r"\\(.)", r"\1", v[1:-1], flags=re.S) if v[0] == '"' else v for _, v in given[:cut])
    return Range(kind.lower(), tuple(zip(own, values, strict=False)), float(quality))


def parse(header: str | None) -> list[Range] | None:
    """Ranges of an Accept header; none for no header, null if it is malformed.

    The whole header has to be spelled by the grammar.  Parameters after ``q`` are
    extensions and do not count.
    """
    found, at = [], 0
    while header and at < len(header):
        member = _MEMBER.match(header, at)
        if not member or (member[3] and member.end() == len(header)):
            return None
        found.append(_range(member[1], _PAIRS.findall(member[2])))
        at = member.end()
    return None if None in found else found


def matches(wanted: Range, offer: tuple[str, tuple]) -> bool:
    """Whether a range takes an offer: its type, and every parameter that it names."""
    kind, has = offer
    if wanted.type not in {kind, kind.partition("/")[0] + "/*", "*/*"}:
        return False
    plain = lambda pairs: {(k, v.lower() if k == "charset" else v) for k, v in pairs}
    return plain(wanted.parameters) <= plain(has)


def score(ranges: list[Range], offers) -> float:
    """The best offer's quality: that of the most specific range that takes it."""
    strictest = sorted(ranges, key=lambda r: (-r.type.count("*"), len(r.parameters), r.q), reverse=True)
    return max((next((r.q for r in strictest if matches(r, offer)), 0.0) for offer in offers), default=0.0)


def prefers_markdown(header: str | None) -> bool:
    """Markdown is named itself, is acceptable, and is wanted more than HTML."""
    ranges = parse(header)
    if not ranges or not any(r.type == MARKDOWN[0] and r.q > 0 and matches(r, MARKDOWN) for r in ranges):
        return False
    return score(ranges, [MARKDOWN]) > score(ranges, HTML)


def _run(header: pd.Series) -> pd.Series:
    # Headers repeat: each distinct one is parsed once per batch.
    codes, distinct = pd.factorize(header, use_na_sentinel=False)
    wanted = [prefers_markdown(None if pd.isna(h) else h) for h in distinct]
    return pd.Series(wanted, dtype=bool).take(codes).reset_index(drop=True)


prefers_markdown_column = F.pandas_udf(_run, T.BooleanType())


def not_modified(if_none_match: Column, etag: Column) -> Column:
    """Whether a conditional request has this entity: ``*`` or its tag, weak or not."""
    given = F.transform(F.split(F.coalesce(if_none_match, F.lit("")), ","), lambda t: F.regexp_replace(F.trim(t), r"\AW/", ""))
    return F.array_contains(given, "*") | F.array_contains(given, etag)


def bodyless(status: Column, method: Column) -> Column:
    return status.isin(204, 205, 304) | (F.upper(method) == "HEAD")


# Headers that describe a body, and go when it is another.
BODY_HEADERS = ("content-length", "content-encoding", "content-language", "content-location", "content-md5", "content-range", "content-type", "etag", "last-modified", "accept-ranges")


def strip_body_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*BODY_HEADERS))


# -- responses -----------------------------------------------------------------


def header(headers: Column, key: str) -> Column:
    """A header's value, whatever the case of its name; null if it is not there."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == key)), F.lit(0))


def html_type(headers: Column) -> Column:
    """``text/html`` or ``application/xhtml+xml``, null for another type."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(header(headers, "content-type"), F.lit("")), ";", 1)))
    return F.when(kind.isin("text/html", "application/xhtml+xml"), kind)


def utf8_html(headers: Column) -> Column:
    """Whether a response is HTML that its header does not say to be other than UTF-8.

    Every charset that is declared has to be UTF-8, and a declaration has to have a value.
    """
    kind = F.coalesce(header(headers, "content-type"), F.lit(""))
    named = F.regexp_extract_all(kind, F.lit(r"(?i);\s*charset\s*=\s*(?:\"([^\"]*)\"|([^;\s\"]+))"), F.lit(0))
    values = F.transform(named, lambda d: F.lower(F.trim(F.regexp_replace(F.regexp_replace(d, r"(?i)\A;\s*charset\s*=\s*", ""), '"', ""))))
    empty = kind.rlike(r"(?i);\s*charset\s*=")
    return html_type(headers).isNotNull() & F.when(F.size(values) == 0, ~empty).otherwise(F.forall(values, lambda v: v.isin("utf-8", "utf8")))


def identity_encoded(headers: Column) -> Column:
    """Whether a body is as it was written: no content coding but ``identity``."""
    value = header(headers, "content-encoding")
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(True)).otherwise(F.forall(F.split(value, ","), lambda c: F.lower(F.trim(c)) == "identity"))


def generated_status(status: Column) -> Column:
    """The status of a generated body in place of another: whole, so never 206."""
    return F.when(status == 206, 200).otherwise(status)
