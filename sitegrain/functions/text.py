"""Text, dates, JSON and escapes as native Spark columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The references that head values may hold, ``&amp;`` last.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#039;", "'"),
    ("&apos;", "'"),
    ("&#x27;", "'"),
    ("&#X27;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)


def _replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def decode_entities(text: Column) -> Column:
    return _replaced(text, ENTITIES)


def escape_text(text: Column) -> Column:
    """For HTML text."""
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def escape_attribute(text: Column) -> Column:
    """For a double-quoted HTML attribute."""
    return _replaced(text, (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")))


def escape_xml(text: Column) -> Column:
    """For XML: characters it may not hold go, five are escaped."""
    legal = F.regexp_replace(text, r"[^\x09\x0a\x0d\x20-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]", "")
    return _replaced(legal, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def table_cell(text: Column) -> Column:
    """For a cell of a Markdown table."""
    return F.regexp_replace(_replaced(text, (("\\", "\\\\"), ("|", "\\|"))), r"\r?\n", " ")


def strip_title_suffix(title: Column, suffixes: str | Sequence[str] | None) -> Column:
    """Remove a site name that a separator sets off at the title's end.

    Separators are ``|``, ``-``, en and em dash and the middle dot.
    """
    if not suffixes:
        return title
    names = [suffixes] if isinstance(suffixes, str) else list(suffixes)
    quoted = "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", s) for s in names)
    return F.trim(F.regexp_replace(title, rf"\s*[|\-\x{{2013}}\x{{2014}}\x{{b7}}]\s*(?:{quoted})\s*\z", ""))


def tokens(content: Column) -> Column:
    """Lower-case words between white space and commas, each once, in order; null gives none."""
    words = F.split(F.lower(F.coalesce(content, F.lit(""))), r"[\s,]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def noindex(robots: Column, also_none: bool = False) -> Column:
    """Whether a robots value forbids indexing; null does not."""
    word = r"(?i)\b(?:noindex|none)\b" if also_none else r"(?i)\bnoindex\b"
    return F.coalesce(robots.rlike(word), F.lit(False))


def iso_date(stamp: Column) -> Column:
    return F.substring(stamp, 1, 10)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 in UTC with milliseconds; what is no date gives null.

    ISO dates and times and RFC 2822 dates are read.
    """
    rfc2822 = F.try_to_timestamp(F.regexp_replace(text, r"\A[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss [z][Z]"))
    stamp = F.coalesce(F.try_to_timestamp(F.trim(text)), rfc2822)
    return F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_full_date(text: Column) -> Column:
    """A calendar date ``yyyy-mm-dd``."""
    return F.coalesce(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(text).isNotNull(), F.lit(False))


def is_rfc3339(text: Column) -> Column:
    """A date and time with its offset, valid by the calendar and the clock."""
    shape = r"\A\d{4}-\d{2}-\d{2}[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+\-]([01]\d|2[0-3]):[0-5]\d)\z"
    return F.coalesce(text.rlike(shape) & F.try_to_date(F.substring(text, 1, 10)).isNotNull(), F.lit(False))


def json_string(text: Column) -> Column:
    """A text as a JSON string, quotes included."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, 6, F.length(whole) - 6)


def pointer_child(pointer: Column, key: Column) -> Column:
    """JSON pointer (RFC 6901) of a member."""
    return F.concat(pointer, F.lit("/"), _replaced(key, (("~", "~0"), ("/", "~1"))))


def humanize(slug: Column) -> Column:
    """Hyphens and underscores as blanks, and a capital at each word's start.

    Unlike ``initcap`` it leaves the rest of a word alone.
    """
    words = F.split(F.regexp_replace(slug, "[-_]", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def etag(body: Column) -> Column:
    """Strong entity tag: the SHA-256 of the UTF-8 body, in quotes."""
    return F.concat(F.lit('"'), F.sha2(body.cast("binary"), 256), F.lit('"'))


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(header, ";", 1)))


def merge_header(header: Column, value: str) -> Column:
    """A comma-separated header with ``value`` in it once, whatever its case."""
    parts = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    there = F.exists(parts, lambda x: (F.lower(x) == value.lower()) | (x == "*"))
    return F.array_join(F.when(there, parts).otherwise(F.array_append(parts, F.lit(value))), ", ")


def source_kind(path: Column, authored: Column) -> Column:
    """What a page was made from, by its source path."""
    return (
        F.when(path.rlike(r"(?i)\Acms:"), "cms")
        .when(path.rlike(r"(?i)\.mdx(\z|[?#])"), "mdx")
        .when(path.rlike(r"(?i)\.md(\z|[?#])"), "markdown")
        .when(path.rlike(r"(?i)\.astro(\z|[?#])"), "astro")
        .when((F.coalesce(path, F.lit("")) != "") | F.coalesce(authored, F.lit(False)), "custom")
        .otherwise("rendered")
    )


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def strip_frontmatter(markdown: Column) -> Column:
    """Without a leading ``---`` block."""
    return F.regexp_replace(markdown, r"(?s)\A---[ \t]*\r?\n.*?\r?\n---[ \t]*(\r?\n|\z)", "")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def content_type(path: Column) -> Column:
    return (
        F.when(path.rlike(r"\.md\z"), "text/markdown; charset=utf-8")
        .when(path.rlike(r"\.json\z"), "application/json; charset=utf-8")
        .when(path.rlike(r"\.jsonld\z"), "application/ld+json; charset=utf-8")
        .when(path.rlike(r"\.xml\z"), "application/xml; charset=utf-8")
        .otherwise("text/plain; charset=utf-8")
    )
