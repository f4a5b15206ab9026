"""Queries over addresses: scopes of sites, identifiers, exact spellings, and manifests as read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..sources import pages as source
from ..sources import sinks
from . import inputs


def site_scopes(spark, sf):
    """Each page's address against the scope of a site: its own, one under a base, or none."""
    p, k = inputs.page_rows(spark, sf), F.col("page_ord")
    origin = F.when(k % 5 == 0, "http://localhost:3000").when(k % 5 == 1, F.concat(F.lit("https://u:p@"), "site")).otherwise(F.concat(F.lit("HTTPS://"), F.upper("site"), F.lit(":443")))
    base = F.when(k % 3 == 0, "/en").when(k % 3 == 1, "").otherwise("/e/")
    rows = p.withColumn("scope", paths.site_scope_column(origin, base))
    plain = F.concat(F.lit("https://"), "site", "pathname")
    return rows.select(
        k.alias("page_id"), "scope", paths.within_site_column(F.col("url"), F.col("scope")).alias("within"),
        (paths.document_key(F.col("url")) == paths.document_key(F.concat(plain, F.lit("/#part")))).alias("same_document"),
    )


def entity_ids(spark, sf):
    """Identifiers that pages might give to entities, as absolute addresses."""
    p, k = inputs.page_rows(spark, sf), F.col("page_ord")
    given = (
        F.when(k % 8 == 0, F.concat(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("#thing"))).when(k % 8 == 1, F.concat(F.lit("../x/./"), k, F.lit("?q#f")))
        .when(k % 8 == 2, F.concat(F.lit("http://127.0.0.1/"), k)).when(k % 8 == 3, "javascript:alert(1)").when(k % 8 == 4, F.concat(F.lit("urn:isbn:"), k))
        .when(k % 8 == 5, F.concat(F.lit("https://me@"), "site")).when(k % 8 == 6, F.concat(F.lit("#"), k)).otherwise("")
    )
    host = (
        F.when(k % 9 == 0, "localhost").when(k % 9 == 1, F.concat("site", F.lit(".LocalHost."))).when(k % 9 == 2, F.concat(F.lit("127."), k % 256, F.lit(".0.1"))).when(k % 9 == 3, "[::1]")
        .when(k % 9 == 4, F.concat(F.lit("localhost."), "site")).when(k % 9 == 5, "::ffff:127.0.0.1").when(k % 9 == 6, F.concat(F.lit("10.0.0."), k % 256)).when(k % 9 == 7, "0.0.0.0").otherwise(F.col("site"))
    )
    base = F.concat(F.lit("https://"), "site", F.lit("/a/b"))
    return p.select(k.alias("page_id"), paths.entity_id_column(given, base).alias("entity_id"), paths.is_loopback(host).alias("loopback"))


def exact_paths(spark, sf):
    """Spellings of artifact paths: the one that may be served, and the decoded key."""
    p, k = inputs.page_rows(spark, sf), F.col("page_ord")
    path = (
        F.when(k % 8 == 0, F.concat(F.lit("/a b/"), k)).when(k % 8 == 1, F.concat(F.lit("/a%20b/"), k)).when(k % 8 == 2, F.concat(F.lit("/a%2Fb/"), k)).when(k % 8 == 3, F.concat(F.lit("/caf%C3%A9/"), k))
        .when(k % 8 == 4, F.concat(F.lit("/caf%c3%a9/"), k)).when(k % 8 == 5, F.concat("pathname", F.lit("/../y"))).when(k % 8 == 6, F.concat(F.lit("/bad%E9/"), k)).otherwise(F.col("pathname"))
    )
    rows = p.select(k.alias("page_id"), path.alias("path"))
    return rows.select("page_id", "path", paths.exact_path_column(F.col("path")).alias("exact"), paths.inspect_path_column(F.col("path")).alias("key"))


def manifest_entries(spark, sf):
    """A manifest with entries of another version, without a path, or cut short, as it is read."""
    place, k = sinks.work_folder(spark, "manifest"), F.col("claim_id")
    version = F.when(k % 7 == 0, 2).when(k % 7 == 1, F.lit(None).cast("int")).otherwise(1)
    line = F.to_json(F.struct("site", F.when(k % 11 != 0, F.col("dest")).alias("pathname"), F.col("owner_name").alias("owner"), F.lit("written").alias("status"), F.sha2("body", 256).alias("etag"), "grp", version.alias("version")))
    inputs.claim_rows(spark, sf).select(F.when(k % 5 == 0, F.substring(line, 1, 25)).when(k % 13 == 0, F.lit("")).otherwise(line).alias("value")).write.text(place)
    return source.manifest(spark, place).select("site", "pathname", "owner", "status", "etag", "grp", "version")


QUERIES = {"site_scopes": site_scopes, "entity_ids": entity_ids, "exact_paths": exact_paths, "manifest_entries": manifest_entries}

B = inputs.BASE
ORACLE_SQL = {
    "site_scopes": B + r""", s AS (
  SELECT *, CASE page_id % 3 WHEN 0 THEN '/en' WHEN 1 THEN '' ELSE '/e' END AS b, page_id % 5 > 1 AS public,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM base)
SELECT page_id, CASE WHEN public THEN 'https://' || site || b || '/' END AS scope,
  public AND starts_with(url, 'https://') AND (p = b OR starts_with(p, b || '/')) AS within,
  regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') = 'https://' || site || pathname AS same_document FROM s""",
    "entity_ids": B + """SELECT page_id,
  CASE page_id % 8 WHEN 0 THEN string_split(url, '#')[1] || '#thing' WHEN 1 THEN 'https://' || site || '/x/' || page_id || '?q#f' WHEN 4 THEN 'urn:isbn:' || page_id WHEN 6 THEN 'https://' || site || '/a/b#' || page_id END AS entity_id,
  page_id % 9 IN (0, 1, 2, 3, 5, 7) AS loopback FROM base""",
    "exact_paths": B + """SELECT page_id,
  CASE page_id % 8 WHEN 0 THEN '/a b/' || page_id WHEN 1 THEN '/a%20b/' || page_id WHEN 2 THEN '/a%2Fb/' || page_id WHEN 3 THEN '/caf%C3%A9/' || page_id WHEN 4 THEN '/caf%c3%a9/' || page_id WHEN 5 THEN pathname || '/../y' WHEN 6 THEN '/bad%E9/' || page_id ELSE pathname END AS path,
  CASE page_id % 8 WHEN 1 THEN '/a%20b/' || page_id WHEN 3 THEN '/caf%C3%A9/' || page_id WHEN 7 THEN nullif(pathname, '/') END AS exact,
  CASE page_id % 8 WHEN 0 THEN '/a b/' || page_id WHEN 1 THEN '/a b/' || page_id WHEN 3 THEN '/café/' || page_id WHEN 4 THEN '/café/' || page_id WHEN 7 THEN pathname END AS key FROM base""",
    "manifest_entries": inputs.CLAIMS + """SELECT site, dest AS pathname, owner_name AS owner, 'written' AS status, sha256(body) AS etag, grp, 1 AS version FROM claims
WHERE claim_id % 5 <> 0 AND claim_id % 13 <> 0 AND claim_id % 7 > 1 AND claim_id % 11 <> 0""",
}
