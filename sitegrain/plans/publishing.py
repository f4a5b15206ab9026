"""Queries over pages: indexes, corpora, records, heads, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Corpus, Profile, Robots, Section, Site
from ..functions import paths, text
from ..operators import corpus, findings, records
from . import inputs

SECTIONS = (Section("English", ("/en/**",)), Section("Deutsch", ("/de/**",)), Section("Romance", ("/fr/**", "/es/*")))
SITE = Site(corpus=Corpus(sections=SECTIONS, default_section="Other"))
SECTION_SQL = "CASE WHEN pathname LIKE '/en/%' OR pathname = '/en' THEN 'English' WHEN pathname LIKE '/de/%' OR pathname = '/de' THEN 'Deutsch' WHEN pathname LIKE '/fr/%' OR pathname = '/fr' OR regexp_full_match(pathname, '/es/[^/]*') THEN 'Romance' ELSE 'Other' END"
RANK_SQL = "CASE section WHEN 'English' THEN 0 WHEN 'Deutsch' THEN 1 WHEN 'Romance' THEN 2 ELSE 3 END"
URL_SQL = "'https://' || site || CASE WHEN pathname = '/' THEN '/' ELSE pathname || '/' END"
MD_SQL = "CASE WHEN pathname = '/' THEN '/index.md' ELSE pathname || '.md' END"


def _titled(spark, sf, *more):
    """First page of each path with its title, by native expressions alone.

    The title is taken before the pages are ranked, so whole pages are not moved
    unless ``more`` asks for them.
    """
    rows = inputs.page_rows(spark, sf).select("site", "pathname", "page_ord", records.native_title(F.col("html")).alias("title"), *more)
    rows = records.first_wins(rows, ["site", "pathname"], "page_ord")
    origin = F.concat(F.lit("https://"), "site")
    return rows.select(
        "site", "pathname", "page_ord", "title", paths.absolute_url(origin, "", F.col("pathname")).alias("url"), paths.md_href(F.col("pathname")).alias("md_href"),
        F.lit("").alias("description"), F.array().cast("array<string>").alias("opt_out_tokens"), F.lit(None).cast("string").alias("modified"), *more,
    )


def llms_index(spark, sf):
    return corpus.text_index(_titled(spark, sf), SITE)


def section_counts(spark, sf):
    title, rank = corpus.section_of(F.col("pathname"), SECTIONS, "Other")
    return _titled(spark, sf).select("site", title.alias("section")).groupBy("site", "section").agg(F.count(F.lit(1)).alias("n"))


def _full(mode):
    site = SITE.but(corpus=Corpus(sections=SECTIONS, full_mode=mode))

    def content(rows):
        rows = rows.select("site", "page_ord", "title", "url", "description", "html")
        return records.with_content(rows, site).withColumn("markdown", F.col("content")["markdown"])

    return lambda spark, sf: corpus.full_corpus(_titled(spark, sf, "html"), site, content=content)


def refused_sites(spark, sf):
    return corpus.refused(_titled(spark, sf), 2)


def path_functions(spark, sf):
    p = F.col("pathname")
    return inputs.page_rows(spark, sf).select(
        F.col("page_ord").alias("page_id"), "site", "pathname", paths.md_pathname(p).alias("md_pathname"), paths.md_href(p, "/base/").alias("md_href"),
        paths.page_of_md(paths.md_pathname(p)).alias("back"), paths.url_path(p, "always").alias("with_slash"), paths.url_path(p, "never").alias("no_slash"),
        paths.absolute_url(F.concat(F.lit("https://"), "site"), "/base", p).alias("absolute"), paths.file_of_page(p).alias("file"),
        paths.strip_base(p, "/en").alias("stripped"), paths.with_base(p, "/en").alias("based"), F.array_join(paths.ancestors(p), " ").alias("ancestors"),
    )


def include_exclude(spark, sf):
    p = F.col("pathname")
    return inputs.page_rows(spark, sf).select(
        F.col("page_ord").alias("page_id"), paths.is_included(p, ["/en/**", "/de/*"], ["/en/1*", "**/*.html"]).alias("included"),
        paths.match_path(p, ["/??/[0-9]*"]).alias("numbered"), paths.match_path(p, "/fr/[!1-4]*").alias("classed"),
    )


def _heads(spark, sf):
    return records.with_head(inputs.tagged_pages(spark, sf).select("site", "pathname", "page_ord", "html"))


def page_eligibility(spark, sf):
    reason = records.skip_reason(F.col("pathname"), F.col("head"), Site(exclude=("/es/**",)))
    return _heads(spark, sf).select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def page_directives(spark, sf):
    h = F.col("head")
    d = records.directives(h)
    return _heads(spark, sf).select(
        F.col("page_ord").alias("page_id"), d["index"].alias("indexed"), d["includeInLlms"].alias("in_index"), d["includeInLlmsFull"].alias("in_full"), d["generateMarkdown"].alias("markdown"),
        F.array_join(text.tokens(h["opt_out"]), " ").alias("tokens"), text.noindex(h["robots"]).alias("noindex"), h["refresh"].alias("refresh"),
        h["description"].alias("description"), text.iso_timestamp(h["modified"]).alias("modified"), h["title"].alias("title"), h["lang"].alias("lang"),
    )


TOKENS_SQL = "CASE page_id % 7 WHEN 1 THEN 'skip' WHEN 2 THEN 'no-llms' WHEN 3 THEN 'no-dotmd no-llms-full' WHEN 4 THEN 'no-llms-full' ELSE '' END"


def title_strip(spark, sf):
    rows = _titled(spark, sf)
    full = F.concat("title", F.lit(" | "), "site")
    return rows.select("site", "pathname", text.strip_title_suffix(F.concat("title", F.lit(" – Site (x)  ")), ["Other", "Site (x)"]).alias("stripped"), full.alias("joined"))


def page_audit(spark, sf):
    return findings.summary(findings.page_audit(_heads(spark, sf)))


def audit_verdict(spark, sf):
    rows = _heads(spark, sf)
    return findings.verdict(findings.page_audit(rows), rows)


def robots_txt(spark, sf):
    robots = Robots(disallow=("BadBot", "OtherBot"), extra=("Crawl-delay: 5",))
    sites = inputs.page_rows(spark, sf).select("site").distinct()
    return sites.select("site", corpus.robots_body(F.concat(F.lit("https://"), "site"), "/docs/", robots, F.length("site") % 2 == 0).alias("body"))


def domain_profile(spark, sf):
    profile = Profile(name="Example", contact="a@example.com", logo="https://e.com/l.png", same_as=("https://x.com/e", "https://y.com/e"))
    return inputs.page_rows(spark, sf).select("site").distinct().select("site", corpus.profile_json(F.concat(F.lit("https://"), "site"), profile).alias("body"))


def url_map(spark, sf):
    return corpus.url_map(_titled(spark, sf).withColumn("title", F.concat("title", F.lit(" a|b\\c"))), "2024-01-01 at 00:00:00")


def etags(spark, sf):
    return inputs.page_rows(spark, sf).select(F.col("page_ord").alias("page_id"), text.etag(F.col("html")).alias("etag"), F.octet_length("html").alias("bytes"))


def missing_alt(spark, sf):
    html = F.replace("html", F.lit("<h1>"), F.lit("<img src=a alt=''><img src='>' data-alt=\"x\"><IMG><h1>"))
    return inputs.page_rows(spark, sf).select(F.col("page_ord").alias("page_id"), findings.missing_alt(html).alias("n"))


def markdown_documents(spark, sf):
    site = SITE.but(frontmatter=True, show_modified=True)
    rows = _titled(spark, sf).withColumn("modified", F.when(F.col("page_ord") % 2 == 0, "2024-05-06T07:08:09.000Z"))
    body = records.markdown_document(F.concat(F.lit('"'), "title", F.lit("\\")), F.col("url"), F.col("description"), F.col("modified"), F.col("title"), site)
    return rows.select("site", "pathname", body.alias("body"))


def text_functions(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    t = F.concat("text", F.lit(" <a href=\"x\">&amp;'|\\</a>\n"), F.col("doc_id"))
    return d.select(
        "doc_id", text.escape_xml(t).alias("xml"), text.escape_attribute(t).alias("attribute"), text.table_cell(t).alias("cell"), text.decode_entities(text.escape_text(t)).alias("back"),
        text.json_string(t).alias("quoted"), text.pointer_child(F.lit("/a"), F.concat("source", F.lit("~/x"))).alias("pointer"), text.humanize(F.lit("hELLO-wide_world")).alias("human"),
        text.source_kind(F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".mdx").when(F.col("doc_id") % 3 == 1, ".md?x").otherwise("")), F.lit(False)).alias("kind"),
        text.is_full_date(F.concat(F.lit("2023-02-"), F.lpad((F.col("doc_id") % 31 + 1).cast("string"), 2, "0"))).alias("is_date"),
    )


def orphans(spark, sf):
    """Markdown files against the links of the index that is made of half the pages."""
    rows = _titled(spark, sf)
    index = corpus.text_index(rows.filter("page_ord % 2 = 0 OR page_ord % 5 = 0"), SITE)
    files = rows.filter("page_ord % 3 != 0").select("site", F.col("md_href").alias("href"))
    opted = rows.filter("page_ord % 7 = 0").select("site", F.col("md_href").alias("href"))
    links = findings.index_links(index)
    both = findings.missing_files(links, files).unionByName(findings.orphan_files(links, files, opted))
    return both.select("site", "code", "severity", "pathname")


QUERIES = {
    "llms_index": llms_index, "section_counts": section_counts, "llms_full_all": _full("all"), "llms_full_index": _full("index"), "llms_full_first_page": _full("first-page-only"),
    "refused_sites": refused_sites, "path_functions": path_functions, "include_exclude": include_exclude, "page_eligibility": page_eligibility, "page_directives": page_directives,
    "title_strip": title_strip, "page_audit": page_audit, "audit_verdict": audit_verdict, "robots_txt": robots_txt, "domain_profile": domain_profile, "url_map": url_map,
    "etags": etags, "missing_alt": missing_alt, "markdown_documents": markdown_documents, "text_functions": text_functions, "missing_and_orphan_files": orphans,
}

B = inputs.BASE


AUDIT_SQL = B + r""", a AS (
  SELECT *, page_id % 4 = 0 AS social, page_id % 90 AS tl, (page_id % 6 = 0)::INT + (page_id % 13 = 0)::INT AS alts FROM base
  WHERE page_id % 11 <> 0 AND page_id % 7 NOT IN (1, 3) AND page_id % 5 NOT IN (0, 1)),
f AS (
  SELECT site, 'title-length' AS code, 'warning' AS severity FROM a WHERE NOT length(title) BETWEEN 30 AND 60
  UNION ALL SELECT site, 'img-missing-alt', 'error' FROM a WHERE len(list_filter(regexp_extract_all(html, '(?i)<img\b(?:"[^"]*"|''[^'']*''|[^>"''])*>'), lambda x: NOT regexp_matches(x, '(?i)(^|\s)alt\s*='))) > 0
  UNION ALL SELECT site, 'og-title-length', 'warning' FROM a WHERE social AND NOT tl BETWEEN 10 AND 70
  UNION ALL SELECT site, 'twitter-card-type', 'warning' FROM a WHERE social AND page_id % 12 = 0
  UNION ALL SELECT site, 'og-image-missing', 'warning' FROM a WHERE social AND page_id % 8 <> 0
  UNION ALL SELECT site, 'og-image-relative', 'warning' FROM a WHERE social AND page_id % 8 = 0
  UNION ALL SELECT site, 'robots-meta-missing', 'warning' FROM a WHERE page_id % 5 NOT IN (0, 1, 2)
  UNION ALL SELECT site, 'no-alternate-link', 'warning' FROM a WHERE alts = 0
  UNION ALL SELECT site, 'duplicate-alternate-link', 'warning' FROM a WHERE alts > 1)
"""

ORACLE_SQL = {
    "llms_index": B + f""", s AS (SELECT *, {SECTION_SQL} AS section FROM firsts),
blocks AS (SELECT site, section, {RANK_SQL} AS rank, '## ' || section || chr(10) || chr(10) || string_agg('- [' || title || '](' || {MD_SQL} || ')', chr(10) ORDER BY page_id) || chr(10) AS block FROM s GROUP BY site, section),
home AS (SELECT site, max(CASE WHEN pathname = '/' THEN title END) AS home FROM firsts GROUP BY site)
SELECT b.site, '# ' || coalesce(nullif(home, ''), b.site) || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY rank) AS body FROM blocks b JOIN home USING (site) GROUP BY b.site, home""",
    "section_counts": B + f"SELECT site, {SECTION_SQL} AS section, count(*) AS n FROM firsts GROUP BY ALL",
    "refused_sites": B + "SELECT site, count(*) AS n_pages FROM firsts GROUP BY site HAVING count(*) > 2",
    "path_functions": B + f"""SELECT page_id, site, pathname, {MD_SQL} AS md_pathname, '/base' || {MD_SQL} AS md_href, pathname AS back,
  CASE WHEN pathname = '/' THEN '/' ELSE pathname || '/' END AS with_slash, pathname AS no_slash,
  'https://' || site || '/base' || CASE WHEN pathname = '/' THEN '/' ELSE pathname || '/' END AS absolute,
  CASE WHEN pathname = '/' THEN '/index.html' ELSE pathname || '/index.html' END AS file,
  CASE WHEN pathname = '/en' THEN '/' WHEN pathname LIKE '/en/%' THEN substr(pathname, 4) END AS stripped,
  CASE WHEN pathname = '/en' OR pathname LIKE '/en/%' THEN pathname ELSE '/en' || pathname END AS based,
  CASE WHEN pathname = '/' THEN '/' ELSE '/ ' || array_to_string(list_transform(range(2, len(string_split(pathname, '/')) + 1), lambda i: array_to_string(string_split(pathname, '/')[1:i], '/')), ' ') END AS ancestors
FROM base""",
    "include_exclude": B + r"""SELECT page_id,
  (pathname = '/en' OR pathname LIKE '/en/%' OR regexp_full_match(pathname, '/de/[^/]*')) AND NOT (regexp_full_match(pathname, '/en/1[^/]*') OR regexp_full_match(pathname, '.*/[^/]*\.html') OR regexp_full_match(pathname, '[^/]*\.html')) AS included,
  regexp_full_match(pathname, '/[^/][^/]/[0-9][^/]*') AS numbered, regexp_full_match(pathname, '/fr/[^1-4][^/]*') AS classed FROM base""",
    "page_eligibility": B + "SELECT CASE WHEN pathname = '/es' OR pathname LIKE '/es/%' THEN 'excluded' WHEN page_id % 11 = 0 THEN 'redirect' WHEN page_id % 5 = 0 THEN 'noindex' WHEN page_id % 7 = 1 THEN 'skip-token' ELSE 'kept' END AS reason, count(*) AS n FROM base GROUP BY 1",
    "page_directives": B + f"""SELECT page_id, page_id % 5 <> 0 AS indexed, page_id % 7 <> 2 AS in_index, page_id % 7 NOT IN (3, 4) AS in_full, page_id % 7 <> 3 AS markdown, {TOKENS_SQL} AS tokens,
  page_id % 5 = 0 AS noindex, page_id % 11 = 0 AS refresh, CASE WHEN page_id % 2 = 0 THEN 'About page ' || page_id || ' & more' END AS description,
  CASE WHEN page_id % 3 = 0 THEN '2024-0' || (1 + page_id % 9) || '-15T10:00:00.000Z' END AS modified, title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM base""",
    "title_strip": B + "SELECT site, pathname, title AS stripped, title || ' | ' || site AS joined FROM firsts",
    "page_audit": AUDIT_SQL + "SELECT code, severity, count(*) AS n FROM f GROUP BY ALL",
    "audit_verdict": AUDIT_SQL + """SELECT b.site, count(f.code) FILTER (severity = 'error') AS errors, count(f.code) FILTER (severity = 'warning') AS warnings,
  any_value(n) AS pages_checked, count(f.code) FILTER (severity = 'error') = 0 AS ok
FROM (SELECT site, count(*) FILTER (page_id % 11 <> 0 AND page_id % 7 NOT IN (1, 3) AND page_id % 5 NOT IN (0, 1)) AS n FROM base GROUP BY site) b LEFT JOIN f USING (site) GROUP BY b.site""",
    "robots_txt": B + """SELECT DISTINCT site, 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || chr(10) || 'User-agent: BadBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: OtherBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) ||
  CASE WHEN length(site) % 2 = 0 THEN 'Sitemap: https://' || site || '/docs/sitemap-index.xml' || chr(10) ELSE '' END || '# llms.txt: https://' || site || '/docs/llms.txt' || chr(10) || 'Crawl-delay: 5' || chr(10) AS body FROM base""",
    "domain_profile": B + """SELECT DISTINCT site, '{"@context":"https://schema.org","@type":"Organization","name":"Example","url":"https://' || site || '","email":"a@example.com","logo":"https://e.com/l.png","sameAs":["https://x.com/e","https://y.com/e"]}' AS body FROM base""",
    "url_map": B + f"""SELECT site, '# Url Map' || chr(10) || 'Generated on 2024-01-01 at 00:00:00' || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || '| URL | Markdown | Title | Last modified |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || pathname || ' | ' || {MD_SQL} || ' | ' || replace(replace(title, '\\', '\\\\'), '|', '\\|') || ' a\\|b\\\\c |  |', chr(10) ORDER BY page_id) || chr(10) AS body FROM firsts GROUP BY site""",
    "etags": "SELECT page_id, '\"' || sha256(html) || '\"' AS etag, strlen(html) AS bytes FROM pages",
    "missing_alt": r"""SELECT page_id, len(list_filter(regexp_extract_all(replace(html, '<h1>', '<img src=a alt=''''><img src=''>'' data-alt="x"><IMG><h1>'), '(?i)<img\b(?:"[^"]*"|''[^'']*''|[^>"''])*>'), lambda x: NOT regexp_matches(x, '(?i)(^|\s)alt\s*='))) AS n FROM pages""",
    "markdown_documents": B + f"""SELECT site, pathname, '---' || chr(10) || 'title: "\\"' || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '\\\\"' || chr(10) || 'url: ' || {URL_SQL} || chr(10) ||
  CASE WHEN page_id % 2 = 0 THEN 'lastModified: 2024-05-06' || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || title || chr(10) AS body FROM firsts""",
    "text_functions": r"""WITH d AS (SELECT doc_id, source, text || ' <a href="x">&amp;''|\</a>' || chr(10) || doc_id AS t FROM documents)
SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
  replace(replace(replace(replace(t, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS attribute, replace(replace(replace(t, '\', '\\'), '|', '\|'), chr(10), ' ') AS cell,
  replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;', '<'), '&gt;', '>').replace('&amp;', '&') AS back,
  '"' || replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' AS quoted, '/a/' || source || '~0~1x' AS pointer, 'HELLO Wide World' AS human,
  CASE doc_id % 3 WHEN 0 THEN 'mdx' WHEN 1 THEN 'markdown' ELSE 'custom' END AS kind, doc_id % 31 + 1 <= 28 AS is_date FROM d""",
    "missing_and_orphan_files": B + f""", r AS (SELECT *, {MD_SQL} AS href FROM firsts)
SELECT site, 'missing-md' AS code, 'error' AS severity, href AS pathname FROM r WHERE (page_id % 2 = 0 OR page_id % 5 = 0) AND page_id % 3 = 0
UNION ALL SELECT site, 'orphan-md', 'warning', href FROM r WHERE page_id % 3 <> 0 AND NOT (page_id % 2 = 0 OR page_id % 5 = 0) AND page_id % 7 <> 0""",
}
