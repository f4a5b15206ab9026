"""Inputs that queries derive from the given tables, the same way as their SQL.

The pages of the tables carry no descriptions, opt-outs or canonical links, so
queries about those write such tags into the pages first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import pages as source

#: Head tags that the derived pages get, by page number.
TAGS_SQL = """concat(
  CASE WHEN page_id % 2 = 0 THEN concat('<meta name="description" content="About page ', page_id, ' &amp; more">') ELSE '' END,
  CASE page_id % 5 WHEN 0 THEN '<meta content="noindex, follow" name="robots">' WHEN 1 THEN '<meta name="robots" content="none">' WHEN 2 THEN '<meta name="robots" content="index">' ELSE '' END,
  CASE page_id % 7 WHEN 1 THEN '<meta name="aeo" content="skip">' WHEN 2 THEN '<meta name="aeo" content="no-llms">' WHEN 3 THEN '<meta name="aeo" content="NO-DOTMD, no-llms-full">' WHEN 4 THEN '<meta name="aeo" content="no-llms-full no-llms-full">' ELSE '' END,
  CASE WHEN page_id % 11 = 0 THEN '<meta http-equiv="refresh" content="0;url=/">' ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN concat('<meta property="article:modified_time" content="2024-0', 1 + page_id % 9, '-15T10:00:00Z">') ELSE '' END,
  CASE WHEN page_id % 4 = 0 THEN concat('<meta property="og:title" content="', repeat('t', CAST(page_id % 90 AS INT)), '">', CASE WHEN page_id % 8 = 0 THEN '<meta property="og:image" content="/i.png">' ELSE '' END, CASE WHEN page_id % 12 = 0 THEN '<meta name="twitter:card" content="summary">' ELSE '' END) ELSE '' END,
  CASE WHEN page_id % 6 = 0 THEN '<link rel="alternate" type="text/markdown" href="/x.md">' ELSE '' END,
  CASE WHEN page_id % 13 = 0 THEN '<link rel="alternate" type="text/markdown" href="/y.md">' ELSE '' END
)"""


def page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """site, pathname, page_ord, url, html."""
    return source.pages(spark, sf)


def tagged_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages with derived tags at the end of their heads."""
    rows = page_rows(spark, sf).withColumn("page_id", F.col("page_ord"))
    return rows.withColumn("html", F.replace("html", F.lit("</head>"), F.concat(F.expr(TAGS_SQL), F.lit("</head>")))).drop("page_id")


#: The same pages in DuckDB: ``base`` (site, pathname, page_id, url, html, title).
BASE = r"""
WITH raw AS (
  SELECT page_id, url, html,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS site,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS p,
         trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\s*>', 1)) AS t
  FROM pages),
base AS (
  SELECT page_id, url, html, site,
         CASE WHEN p = '' THEN '/' WHEN length(p) > 1 AND p LIKE '%/' THEN left(p, length(p) - 1) ELSE p END AS pathname,
         replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title
  FROM raw),
firsts AS (
  SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY site, pathname ORDER BY page_id) = 1)
"""


def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog descriptors derived from documents: nested paths under the language."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(
        F.lit("docs.example").alias("site"),
        F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id") % 50).alias("pathname"),
        (F.col("doc_id") % 3).cast("int").alias("cat_ord"),
        F.col("doc_id").alias("row_ord"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("About "), "doc_id")).alias("description"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("not a date")).when(F.col("doc_id") % 5 == 1, F.lit("2024-02-03T04:05:06Z")).alias("modified"),
    )


CATALOG = """
WITH cat AS (
  SELECT 'docs.example' AS site, '/' || lang || '/' || source || '/' || (doc_id % 50) AS pathname, doc_id % 3 AS cat_ord, doc_id AS row_ord,
         'Doc ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'About ' || doc_id END AS description,
         CASE WHEN doc_id % 5 = 0 THEN 'not a date' WHEN doc_id % 5 = 1 THEN '2024-02-03T04:05:06Z' END AS modified
  FROM documents)
"""


def claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Artifact claims derived from parts."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    path = F.concat(F.lit("/a"), k % 700, F.when(k % 9 == 0, F.concat(F.lit("/b"), k % 4)).otherwise(""))
    return p.select(
        F.lit("parts.example").alias("site"), k.cast("int").alias("claim_id"), F.concat(F.lit("plugin"), k % 3).alias("owner_name"),
        path.alias("served_key"), path.alias("dest"), F.when(k % 4 == 0, F.concat(F.lit("g"), k % 40)).alias("grp"), (k % 6 == 0).alias("replace"),
        F.col("p_name").alias("body"),
    )


CLAIMS = """
WITH claims AS (
  SELECT 'parts.example' AS site, CAST(p_partkey AS INT) AS claim_id, 'plugin' || (p_partkey % 3) AS owner_name,
         '/a' || (p_partkey % 700) || CASE WHEN p_partkey % 9 = 0 THEN '/b' || (p_partkey % 4) ELSE '' END AS dest,
         CASE WHEN p_partkey % 4 = 0 THEN 'g' || (p_partkey % 40) END AS grp, p_partkey % 6 = 0 AS replace, p_name AS body
  FROM part),
counted AS (SELECT *, count(*) OVER (PARTITION BY site, dest) AS n FROM claims),
flagged AS (
  SELECT c.*, (n > 1 OR EXISTS (SELECT 1 FROM claims o WHERE o.dest <> c.dest AND (starts_with(o.dest, c.dest || '/') OR starts_with(c.dest, o.dest || '/')))) AS conflict
  FROM counted c)
"""


def finding_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Findings derived from events."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.concat(F.lit("s"), F.col("user_id") % 20).alias("site"), F.lit("events").alias("producer"), F.col("event_type").alias("code"),
        severity(F.col("event_id")).alias("severity"), F.concat(F.lit("/"), F.col("event_id") % 100).alias("pathname"),
    )


def severity(number: Column) -> Column:
    return F.when(number % 5 == 0, "error").when(number % 5 < 3, "warning").otherwise("info")


FINDINGS = """
WITH f AS (
  SELECT 's' || (user_id % 20) AS site, event_type AS code, CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 5 < 3 THEN 'warning' ELSE 'info' END AS severity,
         '/' || (event_id % 100) AS pathname
  FROM events)
"""
