"""Queries over requests, page sets, claims and findings of whole sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import findings, graphs, ownership, records, runtime
from . import inputs
from .publishing import MD_SQL


def _pages(spark, sf):
    rows = inputs.page_rows(spark, sf)
    return rows.select("site", "pathname", "page_ord", "html", records.native_title(F.col("html")).alias("title"))


def request_responses(spark, sf):
    """A request per page: the page, its Markdown copy or nothing there, in all headers."""
    p, k = _pages(spark, sf), F.col("page_ord")
    first = records.first_wins(p, ["site", "pathname"], "page_ord")
    artifacts = first.select("site", F.col("pathname").alias("served_path"), F.col("html").alias("body")).unionByName(
        first.select("site", paths.md_pathname(F.col("pathname")).alias("served_path"), F.concat(F.lit("md "), "title").alias("body"))
    )
    asked = p.select(
        k.alias("request_id"), "site", F.when(k % 4 == 1, paths.md_pathname(F.col("pathname"))).when(k % 4 == 3, "/zz").otherwise(F.col("pathname")).alias("path"),
        F.when(k % 5 == 0, "HEAD").otherwise("GET").alias("method"), F.when(k % 3 == 0, "text/markdown").when(k % 3 == 1, "text/html").alias("accept"), F.when(k % 7 == 0, "*").alias("if_none_match"),
    )
    return runtime.respond(asked, artifacts).select("request_id", "served_path", "status", "body", "etag")


def page_sets(spark, sf):
    p, k = _pages(spark, sf), F.col("page_ord")
    listed = p.filter(k % 3 == 0).select("site", "pathname", k.alias("row_ord"), "title")
    return runtime.page_set(p.filter(k % 2 == 0).select("site", "pathname"), listed, p.filter(k % 10 == 0).select("site", "pathname").distinct())


def owned_requests(spark, sf):
    p, k = _pages(spark, sf), F.col("page_ord")
    asked = p.select(k.alias("request_id"), "site", F.col("pathname").alias("path"))
    return runtime.project_owned(asked, p.filter(k % 4 == 0).select("site", "pathname"), [r"\A/en/1"])


def gated_pairs(spark, sf):
    p, k = _pages(spark, sf), F.col("page_ord")
    asked = p.select("site", F.when(k % 3 == 0, "/graph.json").when(k % 3 == 1, "/map.xml").otherwise("/other").alias("path"), (k % 5 == 0).alias("owned"))
    return runtime.pair_gate(asked, ("/graph.json", "/map.xml"))


def sitemap_states(spark, sf):
    p, k = _pages(spark, sf), F.col("page_ord")
    files = p.filter(k % 2 == 0).select("site", F.when(k % 3 == 0, "/sitemap-index.xml").when(k % 3 == 1, "/sitemap.xml").otherwise("/a.html").alias("href"))
    return runtime.sitemaps(p, files, "/sitemap-index.xml", "/sitemap.xml")


def published_diagnostics(spark, sf):
    f = inputs.finding_rows(spark, sf).withColumn("code", F.when(F.col("pathname") == "/7", F.upper("code")).otherwise(F.col("code")))
    f = f.withColumn("severity", F.when(F.col("pathname") == "/8", "fatal").otherwise(F.col("severity"))).withColumn("message", F.lit("not to be published"))
    return runtime.diagnostics(f)


def claimant_counts(spark, sf):
    return ownership.claimants(inputs.claim_rows(spark, sf))


def claim_lookups(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    asked = p.select(F.col("p_partkey").alias("request_id"), F.lit("parts.example").alias("site"), F.concat(F.lit("/a"), F.col("p_partkey") % 900).alias("path"))
    return ownership.claim_of(asked, inputs.claim_rows(spark, sf)).select("request_id", "path", "owner_name")


def modified_dates(spark, sf):
    p, k = _pages(spark, sf), F.col("page_ord")
    own = p.select("site", "pathname", k.alias("page_id"), F.when(k % 4 == 0, "2024-05-06T07:08:09Z").when(k % 4 == 1, "no date").alias("modified"))
    stamp = F.when(k % 3 == 0, "never").otherwise(F.concat(F.lit("2023-01-0"), k % 9 + 1, F.lit("T00:00:00Z")))
    return records.with_modified(own, p.select("site", "pathname", stamp.alias("time"))).select("page_id", "modified")


def full_findings(spark, sf):
    n = F.length("site")
    sites = inputs.page_rows(spark, sf).select("site").distinct().select(
        "site", F.when(n % 5 != 0, "x").alias("index_body"), F.when(n % 4 == 0, "").when(n % 4 == 1, "a\n---\n").when(n % 4 == 2, "a").alias("full_body")
    )
    return findings.full_audit(sites).select("site", "code", "severity")


def build_findings(spark, sf):
    p = inputs.page_rows(spark, sf)
    files = p.filter("page_ord % 3 = 0").select("site", F.when(F.col("page_ord") % 2 == 0, "/a.HTML").otherwise("/b.css").alias("href"))
    return findings.build_audit(p, files).select("site", "code", "severity")


def authored_matches(spark, sf):
    p, k = _pages(spark, sf), F.col("page_ord")
    url = F.concat(F.lit("https://"), "site", "pathname")
    inferred = records.first_wins(p, ["site", "pathname"], "page_ord").select("site", "pathname", F.lit("WebPage").alias("type"), url.alias("url"), F.concat(url, F.lit("#page")).alias("id"))
    authored = p.select(
        "site", "pathname", F.when(k % 2 == 0, "WebPage").otherwise("Article").alias("type"), F.when(k % 3 == 0, F.concat(url, F.lit("#x"))).alias("url"),
        F.when(k % 3 == 1, url).otherwise("https://other.example/").alias("id"), k.alias("ord"),
    )
    return graphs.match_authored(inferred, authored).select("site", "pathname", "authored_ord")


def equal_page_graphs(spark, sf):
    p, k = _pages(spark, sf), F.col("page_ord")
    side = lambda extra: p.select("site", "pathname", F.concat("title", extra).alias("entity"), F.array(F.lit("b"), F.lit("a")).alias("roles"), F.lit("[]").alias("provenance"))
    return graphs.equal_graphs(side(F.lit("")), side(F.when(k % 4 == 0, "!").otherwise("")))


_URLS = ("https://a.example/x#y", "/rel", "#frag", "two words", "javascript:alert(1)", "mailto:a@b.example", " java\tscript:x", "plain", "https://a.example/x/")


def url_tests(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    u = F.element_at(F.array(*map(F.lit, _URLS)), (F.col("event_id") % len(_URLS) + 1).cast("int"))
    return e.select(
        "event_id", paths.looks_like_url(u).alias("url_like"), paths.is_unsafe_protocol(u).alias("unsafe"), paths.without_fragment(u).alias("whole"),
        paths.same_path(F.concat(F.lit("/p/"), F.col("event_id") % 3, F.lit("/")), F.concat(F.lit("/p/"), F.col("event_id") % 4)).alias("same"),
    )


def title_units(spark, sf):
    p = _pages(spark, sf)
    return p.select(F.col("page_ord").alias("page_id"), findings.utf16_length(F.concat("title", F.repeat(F.lit("\U0001f600é"), (F.col("page_ord") % 4).cast("int")))).alias("units"))


def content_types(spark, sf):
    k = F.col("page_ord")
    href = F.concat("pathname", F.when(k % 5 == 0, ".md").when(k % 5 == 1, ".txt").when(k % 5 == 2, ".xml").when(k % 5 == 3, ".json").otherwise(".jsonld"))
    return inputs.page_rows(spark, sf).select(k.alias("page_id"), text.content_type(href).alias("content_type"))


QUERIES = {
    f.__name__: f
    for f in (
        request_responses, page_sets, owned_requests, gated_pairs, sitemap_states, published_diagnostics, claimant_counts, claim_lookups, modified_dates, full_findings, build_findings,
        authored_matches, equal_page_graphs, url_tests, title_units, content_types,
    )
}

B = inputs.BASE
_CASE = "CASE event_id % 9 " + " ".join(f"WHEN {{}} THEN {{}}" for _ in _URLS) + " END"


def _picked(*values: object) -> str:
    """The value for each of ``_URLS``, by the number of the event."""
    return _CASE.format(*(x for pair in enumerate(values) for x in pair))


ORACLE_SQL = {
    "request_responses": B + f""", art AS (SELECT site, pathname AS served_path, html AS body FROM firsts UNION ALL SELECT site, {MD_SQL}, 'md ' || title FROM firsts),
req AS (SELECT page_id, site, CASE page_id % 4 WHEN 1 THEN {MD_SQL} WHEN 3 THEN '/zz' ELSE pathname END AS path FROM base),
asked AS (SELECT page_id, site, CASE WHEN page_id % 3 = 0 AND path NOT LIKE '%.md' THEN CASE WHEN path = '/' THEN '/index.md' ELSE path || '.md' END ELSE path END AS served_path FROM req),
found AS (SELECT a.*, body, CASE WHEN body IS NULL THEN 404 WHEN page_id % 7 = 0 THEN 304 ELSE 200 END AS status FROM asked a LEFT JOIN art USING (site, served_path))
SELECT page_id AS request_id, served_path, status, CASE WHEN status <> 304 AND page_id % 5 <> 0 THEN body END AS body, '"' || sha256(body) || '"' AS etag FROM found""",
    "page_sets": B + """, s AS (SELECT DISTINCT site, pathname FROM base WHERE page_id % 2 = 0),
d AS (SELECT site, pathname, title FROM base WHERE page_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY site, pathname ORDER BY page_id DESC) = 1),
o AS (SELECT DISTINCT site, pathname FROM base WHERE page_id % 10 = 0), u AS (SELECT site, pathname, title FROM s FULL JOIN d USING (site, pathname))
SELECT * FROM u ANTI JOIN o USING (site, pathname)""",
    "owned_requests": B + """SELECT page_id AS request_id, site, pathname AS path, starts_with(pathname, '/en/1') OR EXISTS (SELECT 1 FROM base o WHERE o.page_id % 4 = 0 AND o.site = base.site AND o.pathname = base.pathname) AS owned FROM base""",
    "gated_pairs": B + "SELECT site, max(page_id % 5 = 0) AS blocked FROM base WHERE page_id % 3 < 2 GROUP BY site",
    "sitemap_states": B + """, s AS (SELECT site, coalesce(bool_or(page_id % 6 = 0), false) AS has_source, coalesce(bool_or(page_id % 2 = 0 AND page_id % 3 = 1), false) AS has_alias FROM base GROUP BY site)
SELECT *, has_source AND NOT has_alias AS write_alias, has_source OR has_alias AS advertise FROM s""",
    "published_diagnostics": inputs.FINDINGS + "SELECT site, 'events' AS producer, code, severity, pathname FROM f WHERE pathname NOT IN ('/7', '/8')",
    "claimant_counts": inputs.CLAIMS + "SELECT site, dest, owner_name, count(*) AS n FROM claims GROUP BY ALL",
    "claim_lookups": inputs.CLAIMS + """, firsts AS (SELECT dest, arg_min(owner_name, claim_id) AS owner_name FROM claims GROUP BY dest)
SELECT p_partkey AS request_id, '/a' || (p_partkey % 900) AS path, owner_name FROM part LEFT JOIN firsts ON dest = '/a' || (p_partkey % 900)""",
    "modified_dates": B + """, t AS (SELECT site, pathname, max('2023-01-0' || (page_id % 9 + 1) || 'T00:00:00.000Z') FILTER (page_id % 3 <> 0) AS latest FROM base GROUP BY ALL)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '2024-05-06T07:08:09.000Z' ELSE latest END AS modified FROM base JOIN t USING (site, pathname)""",
    "full_findings": B + """, s AS (SELECT DISTINCT site, length(site) AS n FROM base)
SELECT site, 'no-llms' AS code, 'warning' AS severity FROM s WHERE n % 5 = 0
UNION ALL SELECT site, 'no-llms-full', 'warning' FROM s WHERE n % 5 <> 0 AND n % 4 = 3
UNION ALL SELECT site, 'empty-llms-full', 'warning' FROM s WHERE n % 4 = 0
UNION ALL SELECT site, 'llms-full-separators', 'warning' FROM s WHERE n % 4 = 2""",
    "build_findings": B + """, s AS (SELECT site, bool_or(page_id % 3 = 0) AS built, bool_or(page_id % 6 = 0) AS paged FROM base GROUP BY site)
SELECT site, CASE WHEN built THEN 'no-html' ELSE 'no-dist' END AS code, CASE WHEN built THEN 'warning' ELSE 'error' END AS severity FROM s WHERE NOT paged""",
    "authored_matches": B + """, a AS (SELECT site, pathname, min(page_id) AS authored_ord FROM base WHERE page_id % 2 = 0 AND page_id % 3 < 2 GROUP BY ALL)
SELECT f.site, f.pathname, authored_ord FROM firsts f LEFT JOIN a USING (site, pathname)""",
    "equal_page_graphs": B + "SELECT site, pathname, NOT bool_or(page_id % 4 = 0) AS equal FROM base GROUP BY ALL",
    "url_tests": f"""SELECT event_id, {_picked('true', 'true', 'true', 'false', 'true', 'true', 'false', 'false', 'true')} AS url_like,
  {_picked('false', 'false', 'false', 'false', 'true', 'false', 'true', 'false', 'false')} AS unsafe,
  {_picked("'https://a.example/x'", "'/rel'", "''", "'two words'", "'javascript:alert(1)'", "'mailto:a@b.example'", "' java' || chr(9) || 'script:x'", "'plain'", "'https://a.example/x/'")} AS whole,
  event_id % 3 = event_id % 4 AS same FROM events""",
    "title_units": B + "SELECT page_id, length(title) + 3 * (page_id % 4) AS units FROM base",
    "content_types": B + """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/markdown; charset=utf-8' WHEN 1 THEN 'text/plain; charset=utf-8' WHEN 2 THEN 'application/xml; charset=utf-8' WHEN 3 THEN 'application/json; charset=utf-8' ELSE 'application/ld+json; charset=utf-8' END AS content_type FROM base""",
}
