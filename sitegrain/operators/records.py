"""Page records: head features, eligibility, precedence, content."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Site
from ..functions import paths, text
from ..functions.html import dom, markdown, scanner

_META = T.StructType(
    [T.StructField(k, T.StringType()) for k in ("name", "property", "content")]
)
_LINK = T.StructType([T.StructField(k, T.StringType()) for k in ("rel", "href", "type", "hreflang")])
HEAD = T.StructType(
    [
        *(T.StructField(k, T.StringType()) for k in ("title", "lang", "description", "robots", "opt_out", "twitter_card", "og_title", "og_description", "og_image", "modified")),
        T.StructField("refresh", T.BooleanType()),
        T.StructField("has_head", T.BooleanType()),
        T.StructField("links", T.ArrayType(_LINK)),
        T.StructField("metas", T.ArrayType(_META)),
        T.StructField("scripts", T.ArrayType(T.StringType())),
    ]
)
CONTENT = T.StructType(
    [
        *(T.StructField(k, T.StringType()) for k in ("markdown", "strategy", "fallback_reason")),
        *(T.StructField(k, T.IntegerType()) for k in ("selected_nodes", "removed_nodes", "input_characters", "output_characters")),
    ]
)
DIRECTIVES = {"index": None, "includeInLlms": "no-llms", "includeInLlmsFull": "no-llms-full", "generateMarkdown": "no-dotmd"}


def first_wins(df: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key; only a row per key and task is shuffled."""
    by = F.col(order).desc() if last else F.col(order)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).filter("_n = 1").drop("_n")


def with_modified(pages: DataFrame, times: DataFrame, out: str = "modified") -> DataFrame:
    """Add ``out``: the page's own date, or else the latest that ``times`` has for its path.

    ``times`` has (site, pathname, time); a text that is no timestamp counts as none.
    Both are told by site and path, so Spark chooses how they meet.
    """
    latest = times.select("site", "pathname", text.iso_timestamp(F.col("time")).alias("_time")).groupBy("site", "pathname").agg(F.max("_time").alias("_time"))
    own = text.iso_timestamp(F.col(out)) if out in pages.columns else F.lit(None).cast("string")
    return pages.join(latest, ["site", "pathname"], "left").withColumn(out, F.coalesce(own, "_time")).drop("_time")


def site_order(pages: DataFrame, by: str = "canonical_url", out: str = "place") -> DataFrame:
    """Add ``out``: each row's place from 1 in its site, in the order of a locale.

    Ties by the locale's rules go by code point.  A site's rows are ranked by one
    task, as one text is made of them.
    """
    order = Window.partitionBy("site").orderBy(F.collate(F.col(by), "UNICODE"), F.col(by))
    return pages.withColumn(out, F.row_number().over(order))


#: Bytes of text that a task holds as Python objects at a time.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices with about ``PIECE`` bytes in column ``at``, one row at least.

    A batch of Spark's has 10,000 rows, whatever their length.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, function, drop: bool = False) -> DataFrame:
    """Add a column that a Python function makes of each text, in Arrow batches.

    ``drop`` leaves the text itself out, which then need not be handed back.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    df = df.drop(out)
    at = df.columns.index(column)
    kept = [k for k in range(len(df.columns)) if not (drop and k == at)]
    schema = T.StructType([*(df.schema.fields[k] for k in kept), T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_type(kind)
        for whole in batches:
            for batch in pieces(whole, at):
                values = [None if v is None else function(v) for v in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(values, arrow)], names=[*(batch.schema.names[k] for k in kept), out])

    return df.mapInArrow(run, schema)


def with_head(df: DataFrame, html: str = "html", out: str = "head", edit: Callable[[str], str] | None = None, drop: bool = False) -> DataFrame:
    """Add what each page's tags say of it, as a struct; null HTML gives null.

    ``edit`` is done to a page before it is read, in the same process; ``drop``
    leaves the pages out of the result.  With an edit they are left out always.
    """
    names = [f.name for f in HEAD.fields]
    return _mapped(df, html, out, HEAD, lambda v: _picked(v if edit is None else edit(v), names), drop or edit is not None)


def _picked(text_: str, names: list[str]) -> dict:
    found = scanner.head_features(text_)
    return {k: found[k] for k in names}


def native_title(html: Column) -> Column:
    """Title by one expression: what :func:`with_head` finds on pages without raw text before it."""
    return text.decode_entities(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))


def skip_reason(path: Column, head: Column, site: Site) -> Column:
    """Why a page has no record: the first of excluded, redirect, noindex, skip-token; else null."""
    return (
        F.when(~paths.is_included(path, site.include, site.exclude), "excluded")
        .when(head["refresh"], "redirect")
        .when(F.lit(site.respect_noindex) & text.noindex(head["robots"]), "noindex")
        .when(F.array_contains(text.tokens(head["opt_out"]), "skip"), "skip-token")
    )


def directives(head: Column, marker: Column | None = None, authored: Column | None = None) -> Column:
    """The four directives: the marker's, else the author's, else by opt-out tokens."""
    words = text.tokens(head["opt_out"])
    own = {k: ~text.noindex(head["robots"]) if t is None else ~F.array_contains(words, t) for k, t in DIRECTIVES.items()}
    return F.struct(*(F.coalesce(*(s[k] for s in (marker, authored) if s is not None), d).alias(k) for k, d in own.items()))


def with_content(df: DataFrame, site: Site, html: str = "html", url: str | None = "url", out: str = "content") -> DataFrame:
    """Add Markdown of the main content and its diagnostics, as a struct."""
    options = site.extraction
    names = [f.name for f in CONTENT.fields]
    if url is None:
        return _mapped(df, html, out, CONTENT, lambda v: {k: markdown.extract(v, options)[k] for k in names})
    at_html, at_url = df.drop(out).columns.index(html), df.drop(out).columns.index(url)
    schema = T.StructType([*df.drop(out).schema.fields, T.StructField(out, CONTENT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(CONTENT)
        for whole in batches:
            for batch in pieces(whole, at_html):
                rows = zip(batch.column(at_html).to_pylist(), batch.column(at_url).to_pylist(), strict=True)
                values = [None if h is None else markdown.extract(h, options, u) for h, u in rows]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names=[*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


def with_plain_text(df: DataFrame, html: str = "html", out: str = "plain_text") -> DataFrame:
    return _mapped(df, html, out, T.StringType(), lambda v: dom.plain_text(dom.parse(v)))


def records(pages: DataFrame, site: Site, authored: DataFrame | None = None, content: bool = True) -> DataFrame:
    """Page records of (site, pathname, page_ord, url, html), with ``skip_reason``.

    Heads are read for all pages; content only for those that are not skipped:
    the filter stands below the extraction.  ``authored`` rows (site, pathname,
    title, description, image, language, markdown, published, modified) take
    precedence over what the page says, an empty text counting as absent but for
    Markdown.  Of rows with one path the first stays.
    """
    base = with_head(first_wins(pages, ["site", "pathname"], "page_ord"))
    base = base.withColumn("skip_reason", skip_reason(F.col("pathname"), F.col("head"), site))
    fields = ("title", "description", "image", "language", "markdown", "published", "modified")
    if authored is not None:
        own = [F.col(c).alias(f"a_{c}") for c in fields if c in authored.columns]
        base = base.join(authored.select("site", "pathname", *own), ["site", "pathname"], "left")
    for c in fields:
        if f"a_{c}" not in base.columns:
            base = base.withColumn(f"a_{c}", F.lit(None).cast("string"))
    kept = base.filter("skip_reason IS NULL")
    if content:
        kept = with_plain_text(with_content(kept, site))
    else:
        kept = kept.withColumn("content", F.lit(None).cast(CONTENT)).withColumn("plain_text", F.lit(None).cast("string"))
    head = F.col("head")
    origin = F.concat(F.lit("https://"), F.col("site"))
    modified = F.coalesce(text.iso_timestamp(F.col("a_modified")), text.iso_timestamp(head["modified"]))
    return kept.select(
        "site",
        "pathname",
        "page_ord",
        paths.absolute_url(origin, site.base, F.col("pathname"), site.trailing_slash).alias("url"),
        paths.md_href(F.col("pathname"), site.base).alias("md_href"),
        F.coalesce(text.filled(F.col("a_language"), head["lang"], F.lit(site.default_locale)), F.lit(None)).alias("language"),
        F.coalesce(text.filled(F.col("a_title"), text.strip_title_suffix(head["title"], site.strip_title_suffix)), F.lit("")).alias("title"),
        F.coalesce(text.filled(F.col("a_description"), head["description"]), F.lit("")).alias("description"),
        text.filled(F.col("a_image"), head["og_image"]).alias("image"),
        F.coalesce(F.col("a_markdown"), F.col("content.markdown")).alias("markdown"),
        "plain_text",
        text.iso_timestamp(F.col("a_published")).alias("published"),
        modified.alias("modified"),
        text.tokens(head["opt_out"]).alias("opt_out_tokens"),
        directives(head).alias("directives"),
        F.when(F.col("a_markdown").isNotNull(), "markdown-route").otherwise("rendered").alias("strategy"),
        F.col("content").alias("extraction"),
        "head",
    )


def markdown_document(title: Column, url: Column, description: Column, modified: Column, body: Column, site: Site) -> Column:
    """A page's Markdown file, with frontmatter or a footer where asked for."""
    shown = modified.isNotNull() & F.lit(site.show_modified)
    body = F.coalesce(body, F.lit(""))
    ended = F.when(F.endswith(body, F.lit("\n")), body).otherwise(F.concat(body, F.lit("\n")))
    if not site.frontmatter:
        return F.concat(ended, F.when(shown, F.concat(F.lit("\n_Last modified: "), text.iso_date(modified), F.lit("_\n"))).otherwise(""))
    return F.concat(
        F.lit("---\ntitle: "), text.json_string(title), F.lit("\nurl: "), url, F.lit("\n"),
        F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("description: "), text.json_string(description), F.lit("\n"))).otherwise(""),
        F.when(shown, F.concat(F.lit("lastModified: "), text.iso_date(modified), F.lit("\n"))).otherwise(""),
        F.lit("---\n\n"), ended,
    )
