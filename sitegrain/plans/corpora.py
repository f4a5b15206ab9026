"""Full corpora of authored pages: documents as the Markdown of pages, whole texts in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Corpus, Site
from ..operators import corpus

#: Pages of a site of the small ones.
SMALL_SITE = 20
PART_BYTES, PART_PAGES = 1 << 18, 512


def _authored(spark, sf, site: Column) -> DataFrame:
    """Documents as pages with Markdown of their own; some opt out of the corpora."""
    k = F.col("doc_id")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", site.alias("site"), F.col("text").alias("markdown"))
    path = F.when(k % SMALL_SITE == 3, "/").otherwise(F.concat(F.lit("/doc/"), k))
    out = F.when(k % 7 == 2, F.array(F.lit(corpus.NO_FULL))).when(k % 11 == 3, F.array(F.lit(corpus.NO_INDEX), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "site", path.alias("pathname"), k.alias("page_ord"), F.concat(F.lit("Doc "), k).alias("title"), F.concat(F.lit("https://a.example"), path).alias("url"),
        F.when(k % 3 == 0, F.concat(F.lit("About "), k)).alias("description"), out.alias("opt_out_tokens"), "markdown",
    )


def full_corpus_parts(spark, sf):
    """Sites of any size, in pieces that join to their full corpora."""
    rows = corpus.full_parts(_authored(spark, sf, F.coalesce("source", F.lit("none"))), Site(description="All of it"), part_bytes=PART_BYTES, part_pages=PART_PAGES)
    return rows.select("site", "part", "piece", "n_pages", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))


def _small(mode: str):
    """Full corpora of many small sites, in one text each."""

    def query(spark, sf):
        rows = _authored(spark, sf, F.concat(F.lit("site"), F.floor(F.col("doc_id") / SMALL_SITE)))
        full = corpus.full_corpus(rows, Site(corpus=Corpus(full_mode=mode)))
        return full.select("site", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))

    return query


QUERIES = {"full_corpus_parts": full_corpus_parts, "full_corpus_sites": _small("all"), "full_corpus_first_pages": _small("first-page-only"), "full_corpus_roots": _small("index")}


def _pages_sql(site: str) -> str:
    return f"""WITH pages_ AS (
  SELECT doc_id, {site} AS site, CASE WHEN doc_id % {SMALL_SITE} = 3 THEN '/' ELSE '/doc/' || doc_id END AS path, coalesce(text, '') AS body, doc_id % 7 <> 2 AND doc_id % 11 <> 3 AS listed FROM documents),
names AS (SELECT site, coalesce(max(CASE WHEN path = '/' THEN 'Doc ' || doc_id END), site) AS name FROM pages_ GROUP BY site),
texts AS (
  SELECT site, doc_id, path, chr(10) || '# Doc ' || doc_id || chr(10) || chr(10) || 'URL: https://a.example' || path || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Description: About ' || doc_id ELSE '' END
    || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) AS t
  FROM pages_ WHERE listed)"""


def _small_sql(kept: str) -> str:
    return _pages_sql(f"'site' || (doc_id // {SMALL_SITE})") + f""",
kept AS (SELECT site, string_agg(t, '' ORDER BY doc_id) AS t FROM (SELECT * FROM texts {kept}) GROUP BY site),
bodies AS (SELECT site, '# ' || name || chr(10) || chr(10) || '---' || chr(10) || coalesce(t, '') AS b FROM names LEFT JOIN kept USING (site))
SELECT site, strlen(b) AS n_bytes, sha256(b) AS sha256 FROM bodies"""


# The name of a site is that of one root page; where it has several, of the greatest title.
ORACLE_SQL = {
    "full_corpus_parts": _pages_sql("coalesce(source, 'none')") + f""",
runs AS (SELECT site, doc_id >> 10 AS run, count(*) AS n FROM texts GROUP BY ALL),
placed AS (SELECT site, run, CAST(floor((sum(n) OVER (PARTITION BY site ORDER BY run) - n) / {PART_PAGES}) AS BIGINT) AS part FROM runs),
starts AS (SELECT x.site, doc_id, part, t, sum(strlen(t)) OVER (PARTITION BY x.site, part ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - strlen(t) AS start FROM texts x JOIN placed p ON p.site = x.site AND p.run = x.doc_id >> 10),
pieces AS (SELECT site, part, CAST(floor(start / {PART_BYTES}) AS BIGINT) AS piece, count(*) AS n_pages, string_agg(t, '' ORDER BY doc_id) AS b FROM starts GROUP BY ALL
  UNION ALL SELECT site, -1, 0, 0, '# ' || name || chr(10) || chr(10) || '> All of it' || chr(10) || chr(10) || '---' || chr(10) FROM names)
SELECT site, part, piece, n_pages, strlen(b) AS n_bytes, sha256(b) AS sha256 FROM pieces""",
    "full_corpus_sites": _small_sql(""),
    "full_corpus_first_pages": _small_sql("QUALIFY row_number() OVER (PARTITION BY site ORDER BY doc_id) = 1"),
    "full_corpus_roots": _small_sql("WHERE path = '/'"),
}
