"""Per-site texts: index, full corpus, URL map, robots, profile, schema map.

Lines are made row by row; only finished lines meet, ordered, in one text per
site.  Such a text is one document by its nature; ``max_pages`` refuses a site
that is too large for one, before anything is joined up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Corpus, Profile, Robots, Section, Site
from ..functions import paths, text

NO_INDEX = "no-llms"
NO_FULL = "no-llms-full"
NO_MARKDOWN = "no-dotmd"


def ordered(value: str, by: str, separator: str = "\n") -> Column:
    """``listagg`` of a column in the order of others."""
    return F.expr(f"listagg({value}, '{separator}') WITHIN GROUP (ORDER BY {by})")


def _off(tokens: str, token: str, directive: str | None, df: DataFrame) -> Column:
    said = F.array_contains(F.coalesce(F.col(tokens), F.array().cast("array<string>")), token)
    if directive and "directives" in df.columns:
        said = said | ~F.coalesce(F.col("directives")[directive], F.lit(True))
    return said


def index_eligible(df: DataFrame, corpus: Corpus, tokens: str = "opt_out_tokens") -> Column:
    """Pages of the index: not opted out, and with Markdown unless HTML-only pages count."""
    out = ~_off(tokens, NO_INDEX, "includeInLlms", df)
    return out if corpus.include_html_only else out & ~_off(tokens, NO_MARKDOWN, "generateMarkdown", df)


def full_pages(df: DataFrame, corpus: Corpus, tokens: str = "opt_out_tokens") -> DataFrame:
    """Pages of the full corpus, by mode: all, the root alone, or the first in order."""
    kept = df.filter(~_off(tokens, NO_INDEX, "includeInLlms", df) & ~_off(tokens, NO_FULL, "includeInLlmsFull", df))
    if corpus.full_mode == "index":
        return kept.filter(F.col("pathname") == "/")
    if corpus.full_mode == "first-page-only":
        first = F.row_number().over(Window.partitionBy("site").orderBy("page_ord"))
        return kept.withColumn("_n", first).filter("_n = 1").drop("_n")
    return kept


def section_of(path: Column, sections: Sequence[Section], default: str | None, df: DataFrame | None = None) -> tuple[Column, Column]:
    """(title, rank) of the first section whose globs or predicate match, else the default; null drops.

    A predicate that is null does not match; one that is a function is given ``df``.
    """
    titles: list[str] = []
    for s in sections:
        if s.title not in titles:
            titles.append(s.title)
    if default is not None and default not in titles:
        titles.append(default)
    title = F.lit(default)
    for s in reversed(sections):
        hit = paths.match_path(path, s.match) if s.where is None else F.coalesce(s.where if isinstance(s.where, Column) else s.where(df), F.lit(False))
        title = F.when(hit, s.title).otherwise(title)
    rank = F.lit(len(titles))
    for k, t in enumerate(titles):
        rank = F.when(title == t, k).otherwise(rank)
    return title, rank


def entry_line(df: DataFrame, corpus: Corpus, tokens: str = "opt_out_tokens") -> Column:
    """``- [title](href): description _(updated date)_``; HTML-only pages link to themselves."""
    href = F.when(_off(tokens, NO_MARKDOWN, "generateMarkdown", df), F.col("url")).otherwise(F.col("md_href"))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), href, F.lit(")"))
    if corpus.descriptions and "description" in df.columns:
        d = F.coalesce(F.col("description"), F.lit(""))
        line = F.concat(line, F.when(d != "", F.concat(F.lit(": "), d)).otherwise(""))
    if corpus.last_modified and "modified" in df.columns:
        line = F.concat(line, F.coalesce(F.concat(F.lit(" _(updated "), text.iso_date(F.col("modified")), F.lit(")_")), F.lit("")))
    return line


def site_names(df: DataFrame, site: Site) -> DataFrame:
    """(site, name): configured, else the profile's, else the root page's title, else the host."""
    home = F.max(F.when(F.col("pathname") == "/", F.col("title")))
    return df.groupBy("site").agg(
        F.coalesce(text.filled(F.lit(site.name), F.lit(site.profile.name), home, F.col("site")), F.lit("Site")).alias("name")
    )


def refused(df: DataFrame, limit: int | None) -> DataFrame:
    """Sites with more pages than the limit: (site, n_pages).  They get no text."""
    counted = df.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    return counted.filter(F.col("n_pages") > limit) if limit is not None else counted.filter(F.lit(False))


def _header(name: Column, description: str, note: str) -> Column:
    out = F.concat(F.lit("# "), name, F.lit("\n\n"))
    for part in (f"> {description}" if description else "", note):
        if part:
            out = F.concat(out, F.lit(part + "\n\n"))
    return out


def text_index(df: DataFrame, site: Site, note: str = "") -> DataFrame:
    """(site, body): header, then a heading and a list per section that has pages."""
    corpus = site.corpus
    title, rank = section_of(F.col("pathname"), corpus.sections, corpus.default_section, df)
    pages = df.filter(index_eligible(df, corpus)).select("site", "page_ord", title.alias("section"), rank.alias("rank"), entry_line(df, corpus).alias("line"))
    over = refused(df, corpus.max_pages)
    if corpus.max_pages is not None:
        pages = pages.join(over, "site", "left_anti")
        df = df.join(over, "site", "left_anti")
    blocks = pages.filter("section IS NOT NULL").groupBy("site", "section", "rank").agg(ordered("line", "page_ord").alias("lines"))
    blocks = blocks.select("site", "rank", F.concat(F.lit("## "), "section", F.lit("\n\n"), "lines", F.lit("\n")).alias("block"))
    bodies = blocks.groupBy("site").agg(ordered("block", "rank").alias("blocks"))
    return site_names(df, site).join(bodies, "site", "left").select(
        "site", F.concat(_header(F.col("name"), site.description, note), F.coalesce("blocks", F.lit(""))).alias("body")
    )


def _page_text(df: DataFrame, body: str) -> Column:
    """A page of the full corpus: title, address, description, content, rule."""
    d = F.coalesce(F.col("description"), F.lit("")) if "description" in df.columns else F.lit("")
    return F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\nURL: "), F.col("url"),
        F.when(d != "", F.concat(F.lit("\nDescription: "), d)).otherwise(""),
        F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")), F.lit("\n\n---\n"),
    )


def full_corpus(df: DataFrame, site: Site, note: str = "", body: str = "markdown", content: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(site, body): all selected pages' Markdown, each under its title, between rules.

    ``content`` adds the column ``body`` to the selected pages, where they have none yet.
    """
    selected = full_pages(df, site.corpus)
    parts = (content(selected) if content else selected).select("site", "page_ord", _page_text(df, body).alias("part"))
    names = site_names(df, site)
    if site.corpus.max_pages is not None:
        over = refused(df, site.corpus.max_pages)
        parts, names = parts.join(over, "site", "left_anti"), names.join(over, "site", "left_anti")
    bodies = parts.groupBy("site").agg(ordered("part", "page_ord").alias("parts"))
    return names.join(bodies, "site", "left").select(
        "site", F.concat(_header(F.col("name"), site.description, note), F.lit("---\n"), F.coalesce(F.concat(F.lit("\n"), F.col("parts")), F.lit(""))).alias("body")
    )


def full_parts(
    df: DataFrame,
    site: Site,
    note: str = "",
    body: str = "markdown",
    content: Callable[[DataFrame], DataFrame] | None = None,
    part_bytes: int = 8 << 20,
    part_pages: int = 1 << 12,
) -> DataFrame:
    """(site, part, piece, n_pages, body): the full corpus of each site in pieces of bounded size.

    Joined in order of ``part`` and ``piece``, the bodies of a site are the text that
    :func:`full_corpus` gives; the head of the text is part -1.  A part holds less
    than ``part_pages`` + 1,024 pages in a row, and a piece of it is cut before the
    first page that starts ``part_bytes`` or more after the start of one before; so a
    site of any size is dealt to many tasks, and none holds more than a piece and a
    page.  ``page_ord`` is an integer, different for the pages of a site.

    How many pages stand before a run of 1,024 numbers is counted on those two
    columns alone.  Pages then meet these counts, content is made, and its text moves
    to its part; pieces are grouped there without a further shuffle.  ``content`` keeps the columns ``site``,
    ``part`` and ``page_ord``.
    """
    if part_bytes < 1 or part_pages < 1:
        raise ValueError("sizes of parts are 1 or more")
    names = site_names(df, site)
    # Null page numbers come first.
    selected = full_pages(df, site.corpus).withColumn("_run", F.coalesce(F.shiftright("page_ord", 10), F.lit(-1 << 62)))
    if site.corpus.max_pages is not None:
        over = refused(df, site.corpus.max_pages)
        selected, names = selected.join(over, "site", "left_anti"), names.join(over, "site", "left_anti")
    runs = selected.groupBy("site", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("site").orderBy("_run")) - F.col("_n")
    runs = runs.select("site", "_run", F.floor(before / part_pages).alias("part"))
    placed = selected.join(runs, ["site", "_run"])
    texts = (content(placed) if content else placed).select("site", "part", "page_ord", F.concat(F.lit("\n"), _page_text(df, body)).alias("text"))
    ahead = Window.partitionBy("site", "part").orderBy("page_ord")
    starts = F.sum(F.octet_length("text").cast("long")).over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.octet_length("text")
    cut = texts.withColumn("piece", F.floor(starts / part_bytes))
    pieces = cut.groupBy("site", "part", "piece").agg(F.count(F.lit(1)).alias("n_pages"), F.expr("listagg(text, '') WITHIN GROUP (ORDER BY page_ord)").alias("body"))
    zero = F.lit(0).cast("long")
    heads = names.select("site", F.lit(-1).cast("long").alias("part"), zero.alias("piece"), zero.alias("n_pages"), F.concat(_header(F.col("name"), site.description, note), F.lit("---\n")).alias("body"))
    return heads.unionByName(pieces)


def part_files(parts: DataFrame, stem: str = "/llms-full") -> DataFrame:
    """(site, served_path, content_type, body) of :func:`full_parts`, for the sinks; paths sort in the order of the text."""
    path = F.format_string(f"{stem.replace('%', '%%')}/%010d-%06d.txt", F.col("part") + 1, F.col("piece"))
    return parts.select("site", path.alias("served_path"), F.lit("text/plain; charset=utf-8").alias("content_type"), "body")


def url_map(df: DataFrame, stamp: str) -> DataFrame:
    """(site, body): a Markdown table of pages, in order."""
    cells = [F.col("pathname"), F.col("md_href"), F.col("title"), F.coalesce(text.iso_date(F.col("modified")), F.lit("")) if "modified" in df.columns else F.lit("")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(text.table_cell(c) for c in cells)), F.lit(" |"))
    lines = df.select("site", "page_ord", row.alias("line")).groupBy("site").agg(ordered("line", "page_ord").alias("lines"))
    head = f"# Url Map\nGenerated on {stamp}\n\n## Pages\n\n| URL | Markdown | Title | Last modified |\n| --- | --- | --- | --- |\n"
    return lines.select("site", F.concat(F.lit(head), "lines", F.lit("\n")).alias("body"))


def robots_body(origin: Column, base: str, robots: Robots, sitemap: Column | bool = True) -> Column:
    """A robots file: agents, then the sitemap if there is one, the index, other lines."""
    prefix = "" if base in ("", "/") else base.rstrip("/")
    import re

    own = "*" in robots.allow or "*" in robots.disallow or any(re.match(r"user-agent:\s*\*(\s|$)", x.strip(), re.I) for x in robots.extra)
    lines: list[Column] = []
    if robots.universal_allow and not own:
        lines += [F.lit("User-agent: *"), F.lit("Allow: /"), F.lit("")]
    for bots, word in ((robots.allow, "Allow"), (robots.disallow, "Disallow")):
        for bot in bots:
            lines += [F.lit(f"User-agent: {bot}"), F.lit(f"{word}: /"), F.lit("")]
    if robots.sitemap_path:
        here = F.lit(sitemap) if isinstance(sitemap, bool) else sitemap
        lines.append(F.when(here, F.concat(F.lit("Sitemap: "), origin, F.lit(prefix + robots.sitemap_path))))
    if robots.mention_index:
        lines.append(F.concat(F.lit("# llms.txt: "), origin, F.lit(prefix + "/llms.txt")))
    lines += [F.lit(x) for x in robots.extra]
    return F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n"))


def profile_json(origin: Column, profile: Profile) -> Column:
    """A domain profile as JSON; a contact is a URL, an address or a telephone number."""
    contact = profile.contact
    url = F.struct(F.lit("ContactPoint").alias("@type"), F.lit(contact).alias("url"))
    is_url = contact.lower().startswith(("http://", "https://"))
    fields = [
        F.lit("https://schema.org").alias("@context"),
        F.lit(profile.entity_type).alias("@type"),
        F.lit(profile.name).alias("name"),
        F.lit(profile.description or None).cast("string").alias("description"),
        F.coalesce(F.lit(profile.website or None).cast("string"), origin).alias("url"),
    ]
    if contact:
        fields.append(url.alias("contactPoint") if is_url else F.lit(contact).alias("email" if "@" in contact else "telephone"))
    if profile.logo:
        fields.append(F.lit(profile.logo).alias("logo"))
    if profile.same_as:
        fields.append(F.array(*map(F.lit, profile.same_as)).alias("sameAs"))
    return F.to_json(F.struct(*fields))


def schema_map(entries: DataFrame, graph_url: Column, namespace: str = "urn:sitegrain:schema-map:1") -> DataFrame:
    """(site, body): an XML line per page, entity and type.  Entities without id are left out."""
    rows = entries.filter(F.coalesce("id", F.lit("")) != "").select("site", "canonical_url", "id", F.explode("types").alias("type"), graph_url.alias("graph"))
    x = {k: text.escape_xml(F.col(k)) for k in ("graph", "canonical_url", "id", "type")}
    line = F.concat(F.lit('  <entry graph="'), x["graph"], F.lit('" page="'), x["canonical_url"], F.lit('" id="'), x["id"], F.lit('" type="'), x["type"], F.lit('"/>'))
    lines = rows.withColumn("line", line).groupBy("site").agg(ordered("line", "canonical_url, id, type").alias("lines"))
    return lines.select("site", F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<schema-map xmlns="{namespace}">\n'), "lines", F.lit("\n</schema-map>\n")).alias("body"))


def dispatch(path: Column) -> Column:
    """Which artifact a request path asks for; null for a page."""
    return (
        F.when(path == "/llms.txt", "index").when(path == "/llms-full.txt", "full").when(path == "/robots.txt", "robots")
        .when(path == "/.well-known/domain-profile.json", "profile").when(F.endswith(path, F.lit(".md")), "markdown")
    )


def owned_paths(spark, site: Site, extra: Sequence[str] = ()) -> DataFrame:
    """Paths that artifacts own, which no page may have."""
    own = ["/llms.txt", "/llms-full.txt", "/robots.txt", "/.well-known/domain-profile.json", *extra]
    return spark.createDataFrame([(p,) for p in own], "pathname string")
