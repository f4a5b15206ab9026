"""Queries over entity graphs, derived from regions, nations and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, graphs

SITE = "graph.example"


def _entries(spark, sf):
    """An organisation per supplier on its nation's page, with its place; and the page itself."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    n = spark.read.parquet(f"{sf}/nation.parquet")
    k = F.col("s_suppkey")
    page = F.concat(F.lit("/n/"), F.col("s_nationkey"))
    org = F.to_json(F.struct(F.lit("Organization").alias("@type"), F.concat(F.lit(f"https://{SITE}/s/"), k % 60).alias("@id"), F.concat(F.lit("Org "), k % 60).alias("name"), F.struct(F.concat(F.lit(f"https://{SITE}/r/"), k % 9).alias("@id")).alias("location")))
    orgs = s.select(F.lit(SITE).alias("site"), page.alias("pathname"), k.cast("int").alias("ord"), org.alias("entity"), F.when(k % 3 == 0, F.array(F.lit("author"))).otherwise(F.array().cast("array<string>")).alias("roles"), F.lit('[{"source":"api"}]').alias("provenance"))
    doc = F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.concat(F.lit(f"https://{SITE}/n/"), "n_nationkey").alias("@id"), F.col("n_name").alias("name")))
    pages = n.select(F.lit(SITE).alias("site"), F.concat(F.lit("/n/"), "n_nationkey").alias("pathname"), F.lit(-1).alias("ord"), doc.alias("entity"), F.array(F.lit("page")).alias("roles"), F.lit('[{"source":"api"}]').alias("provenance"))
    return pages.unionByName(orgs)


def graph_merge(spark, sf):
    return graphs.merge_pages(_entries(spark, sf)).select("pathname", "id", F.array_join("types", ",").alias("types"), F.array_join("roles", ",").alias("roles"))


def site_graph(spark, sf):
    return graphs.merge_site(_entries(spark, sf)).select("id", F.array_join("types", ",").alias("types"))


def schema_map(spark, sf):
    merged = graphs.merge_pages(_entries(spark, sf)).withColumn("canonical_url", F.concat(F.lit(f"https://{SITE}"), "pathname"))
    return corpus.schema_map(merged, F.lit("https://e.com/graph.jsonld?a&b"))


def roles_duplicate(spark, sf):
    e = _entries(spark, sf)
    more = e.filter("ord % 10 = 1").withColumn("roles", F.array(F.lit("page"), F.lit("site")))
    return graphs.duplicate_roles(e.unionByName(more)).select("pathname", "role", "n")


def unresolved_references(spark, sf):
    e = _entries(spark, sf)
    refs = e.filter("ord >= 0").select("site", "pathname", F.concat(F.lit("/entries/"), "ord", F.lit("/entity/location/@id")).alias("pointer"), F.get_json_object("entity", "$.location['@id']").alias("target"))
    r = spark.read.parquet(f"{sf}/region.parquet").select(F.lit(SITE).alias("site"), F.concat(F.lit(f"https://{SITE}/r/"), "r_regionkey").alias("id"))
    return graphs.unresolved(refs, r).select("pathname", "pointer", "target", "severity")


def graph_findings(spark, sf):
    e = _entries(spark, sf)
    pages = e.filter("ord = -1").select("site", "pathname", F.concat(F.lit(f"https://{SITE}"), "pathname").alias("canonical_url"))
    clash = e.filter("ord % 20 = 4").withColumn("entity", F.replace("entity", F.lit('"Org '), F.lit('"Other ')))
    return graphs.validate_pages(e.unionByName(clash), pages).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def graph_diff(spark, sf):
    e = _entries(spark, sf).filter("ord >= 0")
    side = lambda d: d.select("site", "pathname", F.concat(F.lit("s"), "ord").alias("id"), "entity", "roles", "provenance")
    after = side(e.filter("ord % 5 != 0")).withColumn("entity", F.when(F.col("id").endswith("7"), F.concat("entity", F.lit(" "))).otherwise(F.col("entity")))
    return graphs.diff_graphs(side(e.filter("ord % 4 != 0")), after).select("pathname", "op", "id")


QUERIES = {f.__name__: f for f in (graph_merge, site_graph, schema_map, roles_duplicate, unresolved_references, graph_findings, graph_diff)}

PAGES = "SELECT '/n/' || n_nationkey AS pathname, 'https://graph.example/n/' || n_nationkey AS id, 'WebPage' AS types, 'page' AS roles FROM nation"
ORGS = "SELECT '/n/' || s_nationkey AS pathname, 'https://graph.example/s/' || (s_suppkey % 60) AS id, 'Organization' AS types, CASE WHEN bool_or(s_suppkey % 3 = 0) THEN 'author' ELSE '' END AS roles FROM supplier GROUP BY s_nationkey, s_suppkey % 60"
ORACLE_SQL = {
    "graph_merge": f"{PAGES} UNION ALL {ORGS}",
    "site_graph": f"SELECT DISTINCT id, types FROM ({PAGES} UNION ALL {ORGS})",
    "schema_map": f"""SELECT 'graph.example' AS site, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<schema-map xmlns="urn:sitegrain:schema-map:1">' || chr(10) ||
  string_agg('  <entry graph="https://e.com/graph.jsonld?a&amp;b" page="https://graph.example' || pathname || '" id="' || id || '" type="' || types || '"/>', chr(10) ORDER BY pathname, id, types) || chr(10) || '</schema-map>' || chr(10) AS body FROM ({PAGES} UNION ALL {ORGS})""",
    "roles_duplicate": "WITH r AS (SELECT '/n/' || n_nationkey AS pathname, 'page' AS role FROM nation UNION ALL SELECT '/n/' || s_nationkey, unnest(['page', 'site']) FROM supplier WHERE s_suppkey % 10 = 1) SELECT pathname, role, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1",
    "unresolved_references": "SELECT '/n/' || s_nationkey AS pathname, '/entries/' || s_suppkey || '/entity/location/@id' AS pointer, 'https://graph.example/r/' || (s_suppkey % 9) AS target, 'error' AS severity FROM supplier WHERE s_suppkey % 9 NOT IN (SELECT r_regionkey FROM region)",
    "graph_diff": """WITH e AS (SELECT '/n/' || s_nationkey AS pathname, s_suppkey AS k, 's' || s_suppkey AS id FROM supplier)
SELECT pathname, CASE WHEN k % 4 = 0 THEN 'add' WHEN k % 5 = 0 THEN 'remove' ELSE 'update' END AS op, id FROM e WHERE (k % 4 = 0 AND k % 5 <> 0) OR (k % 4 <> 0 AND k % 5 = 0) OR (k % 4 <> 0 AND k % 5 <> 0 AND k % 10 = 7)""",
}
