"""Queries over catalogs, claims, findings and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import catalog, findings, metrics, ownership
from ..operators.records import first_wins
from ..sources import pages as source
from . import inputs


def catalog_first_wins(spark, sf):
    kept, _ = source.catalog(inputs.catalog_rows(spark, sf))
    return kept.select("site", "pathname", "title", "description", "modified")


def catalog_findings(spark, sf):
    _, found = source.catalog(inputs.catalog_rows(spark, sf))
    return found.groupBy("site", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


def catalog_merge(spark, sf):
    """Concrete pages by supplier nation against a catalog of parts of the key space."""
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    path = F.concat(F.lit("/c/"), k % 400)
    concrete = rows.filter(k % 3 != 0).select(F.lit("s").alias("site"), path.alias("pathname"), k.alias("page_ord"), F.concat(F.lit("page "), k).alias("title"), F.lit("built").alias("origin"))
    listed = rows.filter(k % 4 == 0).select(F.lit("s").alias("site"), path.alias("pathname"), k.alias("row_ord"), F.when(k % 8 == 0, F.concat(F.lit("cat "), k)).alias("title"), F.concat(F.lit("d "), k).alias("description"))
    return catalog.merge(concrete, listed).select("site", "pathname", "title", "origin", "description", F.col("page_order.late").alias("late"), F.col("page_order.ord").alias("ord"))


def last_wins(spark, sf):
    return first_wins(inputs.catalog_rows(spark, sf), ["site", "pathname"], "row_ord", last=True).select("site", "pathname", "title", "row_ord")


def owned_paths_removed(spark, sf):
    owned = spark.createDataFrame([(f"/en/src{k}/{j}",) for k in range(5) for j in range(0, 50, 3)], "pathname string")
    left, found = catalog.without_owned(inputs.catalog_rows(spark, sf).select("site", "pathname", "title"), owned)
    return left.groupBy("site").agg(F.count(F.lit(1)).alias("n")).join(found.groupBy("site").agg(F.count(F.lit(1)).alias("dropped")), "site")


def breadcrumb_trails(spark, sf):
    rows = inputs.catalog_rows(spark, sf)
    up = rows.select("site", F.explode(paths.ancestors(F.col("pathname"))).alias("pathname"), "row_ord").groupBy("site", "pathname").agg(F.min("row_ord").alias("row_ord"))
    names = up.filter("row_ord % 7 != 3").select("site", "pathname", "row_ord", F.concat(F.lit("Step "), "row_ord").alias("title"))
    found = catalog.breadcrumbs(rows.select("site", "pathname"), names)
    line = F.array_join(F.transform("trail", lambda t: F.concat_ws(":", t["position"].cast("string"), t["name"], t["pathname"])), " > ")
    return found.select("site", "pathname", line.alias("trail"))


def artifact_conflicts(spark, sf):
    return ownership.conflicts(inputs.claim_rows(spark, sf)).select("claim_id", "dest", "conflict")


def _resolved(spark, sf):
    claims = ownership.conflicts(inputs.claim_rows(spark, sf))
    owned = claims.withColumn("owner", F.when(F.col("claim_id") % 10 == 0, "public-file"))
    return ownership.resolve(owned)


def ownership_status(spark, sf):
    return _resolved(spark, sf).select("claim_id", "grp", "status")


def ownership_report(spark, sf):
    return ownership.report(_resolved(spark, sf)).select(F.coalesce("owner_name", F.lit("total")).alias("owner"), "n")


def ownership_manifest(spark, sf):
    return ownership.manifest_entries(_resolved(spark, sf), F.col("body")).select("pathname", "owner", "status", "etag", "bytes")


def ownership_findings(spark, sf):
    return findings.summary(ownership.claim_findings(_resolved(spark, sf)))


def external_owners(spark, sf):
    claims = inputs.claim_rows(spark, sf)
    routes = claims.filter("claim_id % 17 = 0").select("site", F.col("served_key").alias("pathname"))
    files = claims.filter("claim_id % 5 = 0").select("site", "dest", F.when(F.col("claim_id") % 2 == 0, "public").otherwise("output").alias("kind"), text.etag(F.col("body")).alias("etag"))
    prior = claims.filter("claim_id % 15 = 0").select("site", F.col("dest").alias("pathname"), text.etag(F.col("body")).alias("etag"), F.lit("emitted").alias("status"))
    return ownership.externally_owned(claims, routes, files, prior).groupBy(F.coalesce("owner", F.lit("none")).alias("owner")).agg(F.countDistinct("claim_id").alias("n"))


def stale_outputs(spark, sf):
    """Orders as the last run's outputs; a fourth of them is claimed again."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey")
    tag, path = text.etag(F.col("o_orderstatus")), F.concat(F.lit("/o/"), k)
    previous = o.select(F.lit("s").alias("site"), path.alias("pathname"), tag.alias("etag"), F.when(k % 3 == 0, F.concat(F.lit("g"), F.floor(k / 30))).alias("grp"), F.lit("emitted").alias("status"))
    claims = o.filter(k % 4 == 0).select(F.lit("s").alias("site"), path.alias("dest"))
    now = o.select(F.lit("s").alias("site"), path.alias("dest"), F.when(k % 11 == 0, F.lit("other")).otherwise(tag).alias("etag"))
    return ownership.stale(previous, claims, now).select("site", "pathname", "grp")


def duplicate_metadata(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    tags = e.select(F.lit("s").alias("site"), F.concat(F.lit("/"), "user_id").alias("pathname"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 3 != 0, F.lit("a")).when(F.col("event_id") % 2 == 0, F.lit("b")).alias("value"))
    return findings.head_conflicts(tags)


def canonical_votes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    links = e.select(F.lit("s").alias("site"), F.concat(F.lit("/"), F.col("event_id") % 500).alias("pathname"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("https://e.com/"), F.floor(F.col("event_id") / 500) % 2)).alias("canonical"))
    return findings.canonical_vote(links)


def finding_summary(spark, sf):
    return findings.summary(inputs.finding_rows(spark, sf))


def finding_distinct(spark, sf):
    return findings.summary(findings.distinct(inputs.finding_rows(spark, sf)))


def finding_gate(spark, sf):
    f = inputs.finding_rows(spark, sf)
    return findings.gate(f.filter("pathname != '/5'"), "error", ("purchase",))


def latency_summary(spark, sf):
    return metrics.latency(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value")


def benchmark_comparison(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    now = e.groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10)).alias("metric")).agg(F.max("value").alias("value"))
    old = e.filter("event_id % 7 = 0").groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10)).alias("metric")).agg(F.max("value").alias("value"))
    return metrics.regressions(now, old).select("metric", "before", "value")


def robots_findings(spark, sf):
    """A robots file per supplier, some with relative maps, unknown lines or no wildcard."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    body = F.concat(
        F.when(k % 2 == 0, "User-agent: *\nAllow: /\n").otherwise("User-agent: Bot # only\nDisallow: /x\n"), F.when(k % 3 == 0, "Sitemap: /map.xml\n").otherwise("Sitemap: https://e.com/map.xml\n"), F.when(k % 5 == 0, "Strange: line\n").otherwise("# note\n"),
    )
    return findings.summary(findings.robots_audit(s.select(F.concat(F.lit("s"), k).alias("site"), body.alias("body"))))


def profile_findings(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    body = F.when(k % 7 == 0, "{not json").otherwise(
        F.concat(F.lit('{"@context":"https://schema.org"'), F.when(k % 2 == 0, ',"@type":"Organization"').otherwise(""), F.when(k % 3 == 0, ',"name":"n"').otherwise(""), F.when(k % 5 == 0, ',"logo":"/l.png"').otherwise(',"url":"https://e.com"'), F.lit("}"))
    )
    return findings.summary(findings.profile_audit(s.select(F.concat(F.lit("s"), k).alias("site"), body.alias("body"))))


def index_findings(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    body = F.concat(F.when(k % 2 == 0, "\n# A\n").otherwise("A\n"), F.when(k % 3 == 0, "# B\n").otherwise(""), F.when(k % 5 == 0, "").when(k % 5 == 1, "- [x](y)\n").otherwise("## C\n"))
    return findings.summary(findings.index_audit(s.select(F.concat(F.lit("s"), k).alias("site"), body.alias("body"))))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_first_wins, catalog_findings, catalog_merge, last_wins, owned_paths_removed, breadcrumb_trails, artifact_conflicts, ownership_status, ownership_report, ownership_manifest,
        ownership_findings, external_owners, stale_outputs, duplicate_metadata, canonical_votes, finding_summary, finding_distinct, finding_gate, latency_summary, benchmark_comparison,
        robots_findings, profile_findings, index_findings,
    )
}

C, L, N = inputs.CATALOG, inputs.CLAIMS, inputs.FINDINGS
RESOLVED = L + """, own AS (SELECT *, CASE WHEN conflict THEN 'conflict' WHEN claim_id % 10 = 0 AND NOT replace THEN 'preserved' WHEN claim_id % 10 = 0 THEN 'replaced' ELSE 'emit' END AS s FROM flagged),
resolved AS (SELECT *, CASE WHEN s IN ('emit', 'replaced') AND grp IS NOT NULL AND NOT bool_and(s IN ('emit', 'replaced')) OVER (PARTITION BY site, grp) THEN 'group-skipped' ELSE s END AS status FROM own)
"""
ORACLE_SQL = {
    "catalog_first_wins": C + "SELECT site, pathname, title, description, CASE WHEN modified LIKE '2024%' THEN '2024-02-03T04:05:06.000Z' END AS modified FROM cat QUALIFY row_number() OVER (PARTITION BY site, pathname ORDER BY cat_ord, row_ord) = 1",
    "catalog_findings": C + """, r AS (SELECT *, row_number() OVER (PARTITION BY site, pathname ORDER BY cat_ord, row_ord) AS n FROM cat)
SELECT site, 'catalog-path-conflict' AS code, 'warning' AS severity, count(*) AS n FROM r WHERE n > 1 GROUP BY site UNION ALL SELECT site, 'catalog-invalid-date', 'warning', count(*) FROM r WHERE n = 1 AND modified = 'not a date' GROUP BY site""",
    "catalog_merge": """WITH c AS (SELECT c_custkey AS k, '/c/' || (c_custkey % 400) AS pathname FROM customer),
a AS (SELECT * FROM c WHERE k % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY pathname ORDER BY k) = 1), b AS (SELECT * FROM c WHERE k % 4 = 0 QUALIFY row_number() OVER (PARTITION BY pathname ORDER BY k DESC) = 1)
SELECT 's' AS site, coalesce(a.pathname, b.pathname) AS pathname, coalesce(CASE WHEN b.k % 8 = 0 THEN 'cat ' || b.k END, 'page ' || a.k) AS title, CASE WHEN a.k IS NOT NULL THEN 'built' END AS origin, 'd ' || b.k AS description, a.k IS NULL AS late, coalesce(a.k, b.k) AS ord
FROM a FULL JOIN b ON a.pathname = b.pathname""",
    "last_wins": C + "SELECT site, pathname, title, row_ord FROM cat QUALIFY row_number() OVER (PARTITION BY site, pathname ORDER BY row_ord DESC) = 1",
    "owned_paths_removed": C + """, o AS (SELECT '/en/src' || k || '/' || j AS pathname FROM range(5) a(k), range(0, 50, 3) b(j))
SELECT site, count(*) FILTER (pathname NOT IN (SELECT pathname FROM o)) AS n, count(*) FILTER (pathname IN (SELECT pathname FROM o)) AS dropped FROM cat GROUP BY site""",
    "breadcrumb_trails": C + """, steps AS (SELECT site, pathname, row_ord, unnest([1, 2, 3, 4]) AS pos, unnest(['/', '/' || string_split(pathname, '/')[2], '/' || string_split(pathname, '/')[2] || '/' || string_split(pathname, '/')[3], pathname]) AS step FROM cat),
names AS (SELECT site, step, min(row_ord) AS o FROM steps GROUP BY ALL), pages AS (SELECT DISTINCT site, pathname, pos, step FROM steps)
SELECT p.site, p.pathname, string_agg(pos || ':Step ' || o || ':' || p.step, ' > ' ORDER BY pos) AS trail FROM pages p LEFT JOIN (SELECT * FROM names WHERE o % 7 <> 3) n ON p.site = n.site AND p.step = n.step GROUP BY p.site, p.pathname HAVING count(o) = 4""",
    "artifact_conflicts": L + "SELECT claim_id, dest, conflict FROM flagged",
    "ownership_status": RESOLVED + "SELECT claim_id, grp, status FROM resolved",
    "ownership_report": RESOLVED + "SELECT owner_name AS owner, count(*) AS n FROM resolved GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM resolved",
    "ownership_manifest": RESOLVED + "SELECT dest AS pathname, owner_name AS owner, CASE WHEN status IN ('emit', 'replaced') THEN 'emitted' ELSE status END AS status, CASE WHEN status IN ('emit', 'replaced') THEN '\"' || sha256(body) || '\"' END AS etag, CASE WHEN status IN ('emit', 'replaced') THEN strlen(body) END AS bytes FROM resolved",
    "ownership_findings": RESOLVED + "SELECT CASE status WHEN 'conflict' THEN 'artifact-conflict' WHEN 'preserved' THEN 'artifact-preserved' WHEN 'replaced' THEN 'artifact-replaced' ELSE 'artifact-group-skipped' END AS code, CASE WHEN status = 'conflict' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM resolved WHERE status <> 'emit' GROUP BY ALL",
    "external_owners": L + """, r AS (SELECT DISTINCT dest FROM claims WHERE claim_id % 17 = 0), fl AS (SELECT dest, max(claim_id % 2 = 0) AS public, max('"' || sha256(body) || '"') AS etag FROM claims WHERE claim_id % 5 = 0 GROUP BY dest), pr AS (SELECT DISTINCT dest, '"' || sha256(body) || '"' AS etag FROM claims WHERE claim_id % 15 = 0)
SELECT CASE WHEN r.dest IS NOT NULL THEN 'project-route' WHEN fl.public THEN 'public-file' WHEN fl.dest IS NOT NULL AND NOT coalesce(pr.etag = fl.etag, false) THEN 'existing-output' ELSE 'none' END AS owner, count(DISTINCT claim_id) AS n
FROM claims c LEFT JOIN r ON r.dest = c.dest LEFT JOIN fl ON fl.dest = c.dest LEFT JOIN pr ON pr.dest = c.dest GROUP BY 1""",
    "stale_outputs": """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'g' || CAST(floor(o_orderkey / 30) AS BIGINT) END AS grp, o_orderkey % 11 <> 0 AS safe FROM orders WHERE o_orderkey % 4 <> 0),
g AS (SELECT *, bool_and(safe) OVER (PARTITION BY grp) AS whole FROM p)
SELECT 's' AS site, '/o/' || k AS pathname, grp FROM g WHERE safe AND (grp IS NULL OR whole)""",
    "duplicate_metadata": "SELECT 's' AS site, '/' || user_id AS pathname, event_type AS key, CASE WHEN count(DISTINCT CASE WHEN event_id % 3 <> 0 THEN 'a' WHEN event_id % 2 = 0 THEN 'b' ELSE '' END) > 1 THEN 'metadata-conflict' ELSE 'metadata-duplicate' END AS code FROM events GROUP BY user_id, event_type HAVING count(*) > 1",
    "canonical_votes": "WITH l AS (SELECT '/' || (event_id % 500) AS pathname, 'https://e.com/' || ((event_id // 500) % 2) AS c FROM events WHERE event_id % 4 <> 0) SELECT 's' AS site, pathname, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS canonical, count(DISTINCT c) > 1 AS conflict FROM l GROUP BY pathname",
    "finding_summary": N + "SELECT code, severity, count(*) AS n FROM f GROUP BY ALL",
    "finding_distinct": N + "SELECT code, severity, count(*) AS n FROM (SELECT DISTINCT * FROM f) GROUP BY ALL",
    "finding_gate": N + "SELECT site, bool_or(severity = 'error' OR code = 'purchase') AS blocked FROM f WHERE pathname <> '/5' GROUP BY site",
    "latency_summary": "SELECT event_type, count(value) AS samples, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS least, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "benchmark_comparison": "WITH a AS (SELECT event_type || '-' || (user_id % 10) AS metric, max(value) AS value FROM events GROUP BY 1), b AS (SELECT event_type || '-' || (user_id % 10) AS metric, max(value) AS before FROM events WHERE event_id % 7 = 0 GROUP BY 1) SELECT metric, before, value FROM a JOIN b USING (metric) WHERE value > before * 1.1",
    "robots_findings": "SELECT * FROM (SELECT 'robots-unknown-line' AS code, 'warning' AS severity, count(*) FILTER (s_suppkey % 5 = 0) AS n FROM supplier UNION ALL SELECT 'robots-relative-sitemap', 'warning', count(*) FILTER (s_suppkey % 3 = 0) FROM supplier UNION ALL SELECT 'robots-no-wildcard', 'warning', count(*) FILTER (s_suppkey % 2 <> 0) FROM supplier) WHERE n > 0",
    "profile_findings": "SELECT * FROM (SELECT 'dp-invalid-json' AS code, 'error' AS severity, count(*) FILTER (s_suppkey % 7 = 0) AS n FROM supplier UNION ALL SELECT 'dp-missing-field', 'error', sum(((s_suppkey % 2 <> 0)::INT + (s_suppkey % 3 <> 0)::INT) * (s_suppkey % 7 <> 0)::INT)::BIGINT FROM supplier UNION ALL SELECT 'dp-relative-url', 'warning', count(*) FILTER (s_suppkey % 7 <> 0 AND s_suppkey % 5 = 0) FROM supplier) WHERE n > 0",
    "index_findings": "SELECT * FROM (SELECT 'llms-no-h1' AS code, 'error' AS severity, count(*) FILTER (s_suppkey % 2 <> 0) AS n FROM supplier UNION ALL SELECT 'llms-multiple-h1', 'warning', count(*) FILTER (s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) FROM supplier UNION ALL SELECT 'llms-empty', 'warning', count(*) FILTER (s_suppkey % 5 = 0) FROM supplier) WHERE n > 0",
}
