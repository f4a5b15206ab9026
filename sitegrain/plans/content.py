"""Queries over page content, and per-request decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Site
from ..functions import accept, paths, text
from ..operators import heads, plugins, records
from ..sources import pages as source
from . import inputs


def extract_markdown(spark, sf):
    out = records.with_content(source.spread(inputs.page_rows(spark, sf)), Site())
    return out.select(F.col("page_ord").alias("page_id"), "content.*")


def plain_text(spark, sf):
    return records.with_plain_text(source.spread(inputs.page_rows(spark, sf))).select(F.col("page_ord").alias("page_id"), "plain_text")


def page_records(spark, sf):
    out = records.records(inputs.tagged_pages(spark, sf), Site(exclude=("/es/**",)))
    return out.drop("head", "extraction", "directives").withColumn("opt_out_tokens", F.array_join("opt_out_tokens", " "))


def title_parity(spark, sf):
    """Titles by the scanner and by the native expression, page by page."""
    out = records.with_head(inputs.page_rows(spark, sf))
    return out.select(F.col("page_ord").alias("page_id"), F.col("head.title").alias("title"), (F.col("head.title") == records.native_title(F.col("html"))).alias("same"))


def alternate_links(spark, sf):
    pages = inputs.tagged_pages(spark, sf).select("page_ord", "html")
    from ..operators.findings import markdown_links

    return records.with_head(pages, edit=lambda v: heads.with_alternate(v, "/self.md", "auto")).select(F.col("page_ord").alias("page_id"), markdown_links(F.col("head.links")).alias("links"))


def enriched_heads(spark, sf):
    pages = records.first_wins(inputs.page_rows(spark, sf), ["site", "pathname"], "page_ord")
    rows = records.with_head(pages).select("site", "pathname", "url", paths.md_href(F.col("pathname")).alias("md_href"), "html", F.col("head.title").alias("title"), F.lit("").alias("description"), F.col("head.lang").alias("language"))
    return heads.enrich(rows).select("site", "pathname", "canonical", "canonical_conflict", F.size("entities").alias("entities"), F.sha2("html", 256).alias("digest"))


def accept_prefers_markdown(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    headers = ["text/markdown", "text/html,text/markdown;q=0.5", "*/*", "text/markdown;q=0.9,text/html;q=0.8", "text/*", 'text/markdown;charset="UTF-8",*/*;q=0.1', "bad header", "text/markdown;q=0"]
    header = F.element_at(F.array(*map(F.lit, headers)), (F.col("event_id") % len(headers) + 1).cast("int"))
    return e.select("event_id", header.alias("header")).select("event_id", "header", accept.prefers_markdown_column(F.col("header")).alias("markdown"))


def conditional_requests(spark, sf):
    p = inputs.page_rows(spark, sf)
    tag = text.etag(F.col("html"))
    sent = F.when(F.col("page_ord") % 4 == 0, "*").when(F.col("page_ord") % 4 == 1, F.concat(F.lit('"x", W/'), tag)).when(F.col("page_ord") % 4 == 2, '"x"')
    return p.select(F.col("page_ord").alias("page_id"), accept.not_modified(sent, tag).alias("not_modified"))


def canonical_urls(spark, sf):
    p = inputs.page_rows(spark, sf)
    made = paths.configured_canonical_column(F.concat(F.lit("HTTPS://"), F.upper("site"), F.lit(":443/x")), F.lit("/base/"), F.col("pathname"), F.lit("never"))
    return p.select(F.col("page_ord").alias("page_id"), paths.stable_canonical_column(F.col("url")).alias("stable"), made.alias("configured"))


def safe_paths(spark, sf):
    """Catalog paths of all kinds, safe and unsafe."""
    p = inputs.page_rows(spark, sf)
    kinds = ["", "/", "//x", "/../x", "/%2e%2e/x", "?q", "%2Fy", "/%2520", "/a%20b", "\\x"]
    tail = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_ord") % len(kinds) + 1).cast("int"))
    raw = F.concat("pathname", tail)
    return p.select(F.col("page_ord").alias("page_id"), raw.alias("raw"), paths.catalog_path_column(raw).alias("safe"))


def rendered(spark, sf):
    return plugins.render(inputs.page_rows(spark, sf).select("page_ord", "html"), [plugins.DensityRenderer()]).select(F.col("page_ord").alias("page_id"), "rendered.status", F.length("rendered.markdown").alias("length"))


def conversation_corpus(spark, sf):
    """Conversations as authored pages: their turns as one Markdown text, in order."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    line = F.concat(F.lit("**"), "role", F.lit("**: "), "text")
    return c.withColumn("line", line).groupBy("conv_id").agg(F.expr("listagg(line, '\n\n') WITHIN GROUP (ORDER BY turn)").alias("markdown"))


QUERIES = {
    f.__name__: f
    for f in (
        extract_markdown, plain_text, page_records, title_parity, alternate_links, enriched_heads, accept_prefers_markdown, conditional_requests, canonical_urls, safe_paths, rendered, conversation_corpus,
    )
}

ORACLE_SQL = {
    "title_parity": inputs.BASE + "SELECT page_id, title, true AS same FROM base",
    "alternate_links": inputs.BASE + "SELECT page_id, CAST(greatest(1, (page_id % 6 = 0)::INT + (page_id % 13 = 0)::INT) AS INT) AS links FROM base",
    "accept_prefers_markdown": """SELECT event_id, ['text/markdown', 'text/html,text/markdown;q=0.5', '*/*', 'text/markdown;q=0.9,text/html;q=0.8', 'text/*', 'text/markdown;charset="UTF-8",*/*;q=0.1', 'bad header', 'text/markdown;q=0'][event_id % 8 + 1] AS header, event_id % 8 IN (0, 3, 5) AS markdown FROM events""",
    "conditional_requests": "SELECT page_id, page_id % 4 IN (0, 1) AS not_modified FROM pages",
    "canonical_urls": inputs.BASE + r"""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]*)$', '\1/') AS stable, 'https://' || site || '/base' || pathname AS configured FROM base""",
    "safe_paths": inputs.BASE + r"""SELECT page_id, pathname || ['', '/', '//x', '/../x', '/%2e%2e/x', '?q', '%2Fy', '/%2520', '/a%20b', '\x'][page_id % 10 + 1] AS raw,
  CASE WHEN page_id % 10 IN (0, 1) AND pathname <> '/' THEN pathname WHEN page_id % 10 = 0 THEN '/' WHEN page_id % 10 = 2 AND pathname <> '/' THEN pathname || '//x' WHEN page_id % 10 IN (7, 8) AND pathname <> '/' THEN pathname || ['/%2520', '/a%20b'][page_id % 10 - 6] END AS safe FROM base""",
    "conversation_corpus": "SELECT conv_id, string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id",
}
