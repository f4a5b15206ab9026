"""Queries over catalogs as a source, artifacts, staged edits, graph views and declared shapes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from ..functions import edits, shapes
from ..operators import corpus, envelopes, explicit, heads, ownership, plugin_artifacts, publishing, records, runtime
from ..operators.plugin_artifacts import GENERATE, VALIDATE, ArtifactPlugin, Claim
from ..operators import graphs as graph_operators
from ..sources import catalogs, sinks, transactions
from ..sources import pages as source
from . import graphs, inputs


def write_policies(spark, sf):
    """Every claim carried out in turn, each with a policy for what is there."""
    k = F.col("claim_id")
    claims = inputs.claim_rows(spark, sf).withColumn("policy", F.when(k % 3 == 0, publishing.SKIP).when(k % 3 == 1, publishing.WARN).otherwise(publishing.OVERWRITE))
    d = F.expr("CAST(regexp_extract(dest, '^/a([0-9]+)', 1) AS INT)")
    files = claims.where(d % 5 == 0).select("site", "dest", F.lit("output").alias("kind")).unionByName(claims.where(d % 7 == 0).select("site", "dest", F.lit("public").alias("kind"))).distinct()
    routes = claims.where(d % 11 == 0).select("site", F.col("served_key").alias("pathname")).distinct()
    decided, findings = publishing.arbitrate(claims, routes, files)
    codes = findings.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    return decided.join(codes, "claim_id", "left").select("claim_id", "dest", "policy", "written", "final", F.coalesce("codes", F.lit("")).alias("codes"))


def published_tree(spark, sf):
    """Claims committed as files, then changed ones; the manifest beside what is in the tree."""
    root = sinks.work_folder(spark, "tree")
    k = F.col("claim_id")
    dest = F.concat(F.lit("/d"), k % 50, F.lit("/"), k, F.lit(".md"))
    claims = inputs.claim_rows(spark, sf).withColumns({"dest": dest, "served_key": dest})
    public = claims.where(k % 10 == 7).select("site", "dest")
    publishing.publish(claims, root, public=public)
    later = claims.where(k % 5 != 0).withColumn("body", F.when(k % 3 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    second = publishing.publish(later, root, public=public)
    there = transactions.fingerprints(claims.select(F.concat("site", "dest").alias("path")).distinct(), root)
    files = there.select(F.col("etag").alias("file_etag"), F.expr("substring(path, length('parts.example') + 1)").alias("pathname"))
    entries = second.manifest.select("pathname", "status", "etag", "bytes")
    return claims.select("claim_id", F.col("dest").alias("pathname")).join(entries, "pathname", "left").join(files, "pathname", "left").select("claim_id", "pathname", "status", "etag", "bytes", "file_etag")


def composed_edits(spark, sf):
    """Pages with the edits of two producers and a redaction, composed before they meet the page."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("s").alias("site"), F.concat(F.lit("/"), "page_id").alias("dest"), F.col("html").alias("body"), "page_id")
    k, none = F.col("page_id"), F.lit(None).cast("string")
    edit = lambda turn, redaction, start, stop, put: F.struct(F.lit(turn).alias("turn"), F.lit(redaction).alias("redaction"), F.lit(start).alias("start"), F.lit(stop).alias("stop"), put.alias("put"))
    every = F.array_compact(
        F.array(
            edit(0, False, 0, 0, F.lit("<!--a-->")), edit(0, False, 10, 20, none), F.when(k % 3 == 0, edit(1, False, 5, 15, F.lit("XY"))),
            F.when(k % 2 == 0, edit(9, True, 30, 40, F.when(k % 4 == 0, F.lit("#")))),
        )
    )
    rows = pages.select("site", "dest", F.explode(every).alias("e")).select("site", "dest", "e.*")
    done = pages.join(edits.staged(rows, ["site", "dest"]), ["site", "dest"], "left").withColumn("body", edits.splice(F.col("body"), F.col("edits")))
    return done.select("page_id", F.length("body").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), "fault")


def loaded_catalogs(spark, sf):
    """Documents as a catalog of JSON lines per language, read by the data source; two catalogs fail."""
    place = sinks.work_folder(spark, "catalog-files")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    title = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("Doc "), "doc_id"))
    path = F.when(F.col("doc_id") % 9 == 0, F.lit("no path")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id") % 300))
    d.select("lang", path.alias("pathname"), title.alias("title"), F.col("n_chars").alias("description")).write.partitionBy("lang").json(place)
    names = ["en", "fr", "de", "es"]
    specs = [{"name": n, "loader": "sitegrain.sources.catalogs:json_lines", "args": {"path": f"{place}/lang={n}"}} for n in names]
    specs += [{"name": "gone", "loader": "sitegrain.sources.catalogs:json_lines", "args": {"path": f"{place}/lang=none"}}, {"name": "none", "loader": "sitegrain.sources.catalogs:SCHEMA"}]
    kept, found = catalogs.load(spark, "docs.example", specs)
    rows = kept.groupBy("catalog").agg(F.count("*").alias("n"), F.count("description").alias("n_text"))
    bad = found.groupBy(F.col("code").alias("catalog")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_text"))
    return rows.unionByName(bad)


#: Descriptors derived from documents, with a fault by number; the same in both engines.
_FAULTS = [
    ("'/d/' || doc_id", ""), ("'d/' || doc_id", ""), ("'/d/' || doc_id", ', "title": 7'), ("'/d/' || doc_id", ', "rendering": "never"'), ("'/d/' || doc_id", ', "dates": {"published": "2024-02-30"}'),
    ("'/d/' || doc_id", ', "entities": [{"@type": "A"}, {"@id": "b"}]'), ("'/d/' || doc_id", ', "directives": {"index": "yes"}'), ("'/d/' || doc_id", ', "title": "fine", "authors": ["x", 3]'), ("'/d/' || doc_id", ', "dates": {"published": "2024-02-29"}, "source": {"kind": "cms"}'),
]
_POINTERS = [None, "/pathname", "/title", "/rendering", "/dates/published", "/entities/1/@type", "/directives/index", "/authors/1", None]


def broken_descriptors(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    which = F.col("doc_id") % len(_FAULTS)
    json = F.lit(None).cast("string")
    for k, (path, more) in enumerate(_FAULTS):
        json = F.when(which == k, F.concat(F.lit('{"pathname": "'), F.expr(path), F.lit('"' + more + "}"))).otherwise(json)
    return d.select("doc_id", shapes.fault(shapes.DESCRIPTOR, shapes.parsed(json)).alias("pointer"))


def _organisations(entries):
    """The entries with an id of its own for each organisation, so none clash."""
    own = F.format_string('{"@type":"Organization","@id":"https://graph.example/s/%d","name":"Org %d"}', F.col("ord"), F.col("ord"))
    return entries.withColumn("entity", F.when(F.col("ord") >= 0, own).otherwise(F.col("entity")))


def reconciled_graphs(spark, sf):
    """Managed and whole views per nation's page after edits of either; what became of them."""
    entries = _organisations(graphs._entries(spark, sf))
    k = F.expr("CAST(substring(pathname, 4) AS INT)")
    plain = entries.withColumn("roles", F.array().cast("array<string>"))
    of = lambda df, view: df.select("site", "pathname", F.lit(view).alias("view"), "ord", "entity", "roles", "provenance")
    authored, managed = plain.where("ord = -1"), plain.where("ord >= 0")
    base = of(authored, "authored").unionByName(of(managed, "managed")).unionByName(of(plain, "whole"))
    extra = authored.withColumn("ord", F.lit(1 << 30)).withColumn("entity", F.format_string('{"@type":"Person","@id":"https://graph.example/x%d"}', k))
    more_managed, more_whole = of(extra.where(k % 5 == 0), "managed"), of(extra.where((k % 5 == 1) | (k % 5 == 2)), "whole")
    both = of(extra.where(k % 5 == 2), "managed")
    edited = base.where(~((k % 5 == 3) & (F.col("view") == "whole") & (F.col("ord") == -1))).unionByName(more_managed).unionByName(more_whole).unionByName(both)
    pages = authored.select("site", "pathname", F.concat(F.lit("https://graph.example"), "pathname").alias("canonical_url"))
    out = envelopes.reconcile_pages(base, edited, pages)
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    entry = F.col("kind") == "entry"
    return out.groupBy("pathname").agg(
        F.bool_or("managed_changed").alias("managed_changed"), F.bool_or("whole_changed").alias("whole_changed"), F.max(F.when(F.col("kind") == "finding", F.col("code"))).alias("code"),
        n(entry & (F.col("view") == "managed"), "n_managed"), n(entry & (F.col("view") == "whole"), "n_whole"), n(F.col("kind") == "patch", "n_patch"),
    )


def site_references(spark, sf):
    """References and clashing ids of all pages of a site together."""
    e = graphs._entries(spark, sf)
    clash = e.where("ord % 20 = 4").withColumn("entity", F.replace("entity", F.lit('"Org '), F.lit('"Other ')))
    regions = spark.read.parquet(f"{sf}/region.parquet").select(F.lit(graphs.SITE).alias("site"), F.lit("/r").alias("pathname"), F.col("r_regionkey").cast("int").alias("ord"), F.format_string('{"@type":"Place","@id":"https://graph.example/r/%d"}', "r_regionkey").alias("entity"))
    rows = e.select("site", "pathname", "ord", "entity").unionByName(clash.select("site", "pathname", "ord", "entity")).unionByName(regions)
    sites = spark.range(1).select(F.lit(graphs.SITE).alias("site"), F.lit("https://graph.example/").alias("site_url"))
    return envelopes.site_findings(rows, sites).select("code", "severity", "entity_id", "pointer")


def entity_positions(spark, sf):
    """Entities of the site in the order of its graph document, numbered within each page."""
    from pyspark.sql import Window

    e = graphs._entries(spark, sf).where("ord >= 0").select("pathname", "ord", "entity")
    return e.withColumn("place", F.row_number().over(Window.partitionBy("pathname").orderBy(*envelopes.entity_order(F.col("entity")), "ord"))).select("pathname", "ord", "place")


def _count_pages(claims, pages):
    own = F.col("plugin") == "counts"
    out = claims.join(pages.groupBy("site").agg(F.count("*").alias("n")), "site", "left")
    out = out.withColumn("body", F.when(own, F.concat(F.lit("pages: "), "n")).otherwise(F.col("body")))
    return out.withColumn("content_type", F.when(own, F.lit("text/plain")).otherwise(F.col("content_type"))).drop("n")


def _breaks(claims, pages):
    return claims.withColumn("body", F.raise_error(F.lit("no content today")).cast("string"))


PLUGINS = (
    ArtifactPlugin("breaks", (Claim("x", "/late.txt"),), {GENERATE: _breaks}),
    ArtifactPlugin("counts", (Claim("a", "/counts.txt", group="g"), Claim("b", "/owned.txt", replace=True), Claim("c", "/kept.txt", group="g")), {GENERATE: _count_pages}),
    ArtifactPlugin("shouts", (), {VALIDATE: lambda claims, pages: claims.withColumn("body", F.upper("body"))}),
)


def plugin_artifact_plan(spark, sf):
    """Artifacts of three plugins, one of which fails, in the ownership plan of each site."""
    pages = inputs.page_rows(spark, sf)
    made = plugin_artifacts.produce(PLUGINS, pages)
    k = F.col("page_ord")
    routes = pages.where(k % 2 == 0).select("site", F.explode(F.array(F.lit("/owned.txt"), F.lit("/kept.txt"))).alias("pathname")).distinct()
    none = pages.limit(0).select("site", F.col("pathname").alias("dest"), F.lit("output").alias("kind"), F.lit("").alias("etag"))
    plan = ownership.resolve(ownership.externally_owned(ownership.conflicts(made.claims), routes, none))
    found = made.findings.select(F.coalesce("site", F.lit("-")).alias("site"), F.coalesce("pathname", F.lit("-")).alias("pathname"), F.col("plugin").alias("owner"), F.col("code").alias("status"), F.lit(None).cast("string").alias("body"))
    return plan.select("site", F.col("dest").alias("pathname"), F.col("owner_name").alias("owner"), "status", "body").unionByName(found)


def stated_heads(spark, sf):
    """Pages with the head that they state themselves."""
    @F.pandas_udf("string")
    def state(html: pd.Series, said: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([explicit.state(h, json.loads(s), u, "https://e.com/")[0] for h, s, u in zip(html, said, url, strict=True)])

    p = spark.read.parquet(f"{sf}/pages.parquet")
    k = F.col("page_id")
    said = F.concat(F.lit('{"title": "New '), k, F.lit(' & more", "robots": ["noindex", "nofollow"]'), F.when(k % 2 == 0, F.lit(', "openGraph": {"type": "article", "images": ["/i.png"]}')).otherwise(""), F.lit("}"))
    return p.select("page_id", F.sha2(state("html", said, F.concat(F.lit("https://e.com/p/"), k)).cast("binary"), 256).alias("sha256"))


_TYPES = ["text/html", "text/html; charset=utf-8", 'text/html;charset="UTF8"', "text/html; charset=latin-1", "application/json", "application/xhtml+xml; charset=", "Text/HTML ; a=b"]


def represented_responses(spark, sf):
    """Upstream responses of all kinds, of which some are replaced by a generated text."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    k = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (k % len(_TYPES) + 1).cast("int"))
    headers = F.map_concat(F.create_map(F.lit("Content-Type"), kind, F.lit("X-Kept"), F.lit("1"), F.lit("Last-Modified"), F.lit("then")), F.when(k % 5 == 1, F.create_map(F.lit("Content-Encoding"), F.lit("gzip"))).when(k % 5 == 2, F.create_map(F.lit("content-encoding"), F.lit("Identity"))).otherwise(F.create_map().cast("map<string,string>")))
    made = F.when(k % 11 != 0, F.concat(F.lit("md "), k))
    rows = p.select(
        k.alias("request_id"), F.when(k % 3 == 0, "HEAD").otherwise("GET").alias("method"), F.when(k % 4 == 0, "*").alias("if_none_match"), F.when(k % 6 == 0, 206).when(k % 6 == 1, 404).otherwise(200).alias("status"),
        headers.alias("headers"), F.lit("upstream").alias("body"), made.alias("generated"), F.lit("text/markdown").alias("generated_type"),
    )
    out = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), "|")
    return runtime.represent(rows).select("request_id", "replaced", "status", out.alias("headers"), "body")


def marked_pages(spark, sf):
    """Pages with payloads embedded in scripts: read, reported where they are none, and removed."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    k = F.col("page_id")
    script = lambda body: F.concat(F.lit("<script type='application/json' data-own>"), body, F.lit("</script>"))
    good = script(F.concat(F.lit('{"title": "M '), k, F.lit('"}')))
    put = F.when(k % 4 == 0, good).when(k % 4 == 1, script(F.lit("[1]"))).when(k % 4 == 2, F.concat(script(F.lit("{")), good, good)).otherwise("")
    rows = p.select("page_id", F.lit("s").alias("site"), F.lit("/").alias("pathname"), F.concat(F.replace("html", F.lit("</head>"), F.concat(put, F.lit("</head>"))), put).alias("html"))
    shown = rows.withColumn("m", heads.markers(F.col("html"), "data-own"))
    return shown.select("page_id", F.get_json_object("m.payload", "$.title").alias("title"), F.array_join("m.codes", ",").alias("codes"), F.sha2(F.col("m.html").cast("binary"), 256).alias("sha256"))


def page_places(spark, sf):
    """Pages of a site in the order of a locale, which is not that of code points."""
    p = inputs.page_rows(spark, sf)
    letters = F.translate(F.col("page_ord").cast("string"), "0123456789", "abcdefghij")
    name = F.when(F.col("page_ord") % 3 == 0, F.upper(letters)).otherwise(letters)
    return records.site_order(p.select("site", "page_ord", name.alias("name")), "name").select("site", "page_ord", "name", "place")


def artifact_requests(spark, sf):
    """Requests for artifacts and Markdown copies among those for pages: what is asked for, and the answer."""
    p = inputs.page_rows(spark, sf)
    k = F.col("page_ord")
    paths_ = ["/llms.txt", "/llms-full.txt", "/robots.txt", "/.well-known/domain-profile.json"]
    path = F.col("pathname")
    for j, named in enumerate(paths_):
        path = F.when(k % 7 == j, named).otherwise(path)
    path = F.when(k % 7 == 4, F.concat(F.lit("/p"), k, F.lit(".md"))).otherwise(path)
    asked = p.select(k.alias("request_id"), "site", path.alias("path"), F.lit("GET").alias("method"), F.lit("text/markdown").alias("accept"), F.lit(None).cast("string").alias("if_none_match"))
    there = p.select("site", F.explode(F.array(*[F.lit(x) for x in paths_[:3]])).alias("served_path")).distinct().withColumn("body", F.concat("site", "served_path"))
    return runtime.respond(asked, there).select("request_id", "path", corpus.dispatch(F.col("path")).alias("artifact"), "status", "body")


def read_manifests(spark, sf):
    """A manifest written line by line, some of them broken, of another version or without a path."""
    place = sinks.work_folder(spark, "manifest")
    k = F.col("p_partkey")
    line = F.to_json(F.struct(F.lit("parts.example").alias("site"), F.when(k % 7 != 0, F.concat(F.lit("/a"), k)).alias("pathname"), F.lit("core").alias("owner"), F.lit("emitted").alias("status"), F.when(k % 11 == 0, 2).otherwise(1).alias("version")))
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.when(k % 5 == 0, F.concat(F.lit("{"), line)).when(k % 5 == 1, F.lit("no json")).otherwise(line).alias("value"))
    rows.write.text(place)
    return source.manifest(spark, place).select("site", "pathname", "owner", "status", "version")


def replayed_patches(spark, sf):
    """Patches made for each page's entries, replayed over entries that have changed since; a page without any left has no row."""
    e = _organisations(graphs._entries(spark, sf).where("ord >= 0"))
    ident = lambda r: F.col("ord") % 5 == r
    entry = lambda entity: F.concat(F.lit('{"entity":'), entity, F.lit(',"provenance":[{"source":"api"}],"roles":'), F.to_json("roles"), F.lit("}"))
    new = F.replace("entity", F.lit('"Org '), F.lit('"Firm '))
    name = F.to_json(F.array(F.get_json_object("entity", "$['@id']")))
    quoted = F.expr("substring(n, 2, length(n) - 2)")
    ops = e.withColumn("n", name).withColumn(
        "patch",
        F.when(ident(0), F.concat(F.lit('[{"op":"remove","id":'), quoted, F.lit(',"before":'), entry(F.col("entity")), F.lit("}]")))
        .when(ident(1) | ident(2), F.concat(F.lit('[{"op":"update","id":'), quoted, F.lit(',"before":'), entry(F.col("entity")), F.lit(',"after":'), entry(new), F.lit("}]"))),
    )
    base = e.withColumn("entity", F.when(ident(2), F.replace("entity", F.lit('"Org '), F.lit('"Other '))).otherwise(F.col("entity")))
    out = graph_operators.patch_pages(base, ops.where("patch IS NOT NULL").select("site", "pathname", "patch"))
    return out.groupBy("pathname").agg(F.count("conflict").alias("conflicts"), F.count("entity").alias("entries"), F.count(F.when(F.col("entity").contains('"Firm '), 1)).alias("firms"))


QUERIES = {f.__name__: f for f in (write_policies, published_tree, composed_edits, loaded_catalogs, broken_descriptors, reconciled_graphs, site_references, entity_positions, plugin_artifact_plan, stated_heads, represented_responses, marked_pages, page_places, artifact_requests, read_manifests, replayed_patches)}

_LISTED = "[" + ", ".join(f"'{t}'" for t in _TYPES) + "]"
_SIDES = "SELECT n_nationkey AS k, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS orgs FROM nation"
ORACLE_SQL = {
    "write_policies": inputs.CLAIMS.replace("flagged AS (", "unused AS (") + """,
c AS (SELECT claim_id, owner_name, dest, CASE claim_id % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'warn-overwrite' ELSE 'overwrite' END AS policy,
  CAST(regexp_extract(dest, '^/a([0-9]+)', 1) AS INT) AS d, row_number() OVER (PARTITION BY dest ORDER BY claim_id) AS place FROM claims),
w AS (SELECT *, policy <> 'skip' OR (place = 1 AND d % 5 <> 0 AND d % 7 <> 0 AND d % 11 <> 0) AS written FROM c),
p AS (SELECT *, (SELECT arg_max(o.owner_name, o.claim_id) FROM w o WHERE o.dest = w.dest AND o.claim_id < w.claim_id AND o.written) AS prior,
  NOT EXISTS (SELECT 1 FROM w o WHERE o.dest = w.dest AND o.claim_id > w.claim_id AND o.written) AS last FROM w)
SELECT claim_id, dest, policy, written, written AND last AS final, array_to_string(list_sort(list_filter([
  CASE WHEN (d % 5 = 0 OR prior IS NOT NULL) AND (policy = 'warn-overwrite' OR NOT written) THEN 'artifact-exists' END,
  CASE WHEN prior <> owner_name THEN 'artifact-owner-' || CASE WHEN written THEN 'overwritten' ELSE 'retained' END END,
  CASE WHEN d % 11 = 0 THEN 'artifact-route-' || CASE WHEN written THEN 'overwritten' ELSE 'retained' END END,
  CASE WHEN d % 7 = 0 THEN 'artifact-public-' || CASE WHEN written THEN 'overwritten' ELSE 'retained' END END], lambda x: x IS NOT NULL)), ',') AS codes FROM p""",
    "published_tree": inputs.CLAIMS.replace("flagged AS (", "unused AS (") + """,
ok AS (SELECT claim_id, '/d' || (claim_id % 50) || '/' || claim_id || '.md' AS dest, grp, body, CASE WHEN claim_id % 10 = 7 AND NOT replace THEN 'preserved' ELSE 'emitted' END AS own FROM claims),
one AS (SELECT *, CASE WHEN own = 'emitted' AND grp IS NOT NULL AND NOT bool_and(own = 'emitted') OVER (PARTITION BY grp) THEN 'group-skipped' ELSE own END AS status FROM ok),
two AS (SELECT claim_id, CASE WHEN claim_id % 3 = 0 THEN body || '!' ELSE body END AS body, CASE WHEN own = 'emitted' AND grp IS NOT NULL AND NOT bool_and(own = 'emitted') OVER (PARTITION BY grp) THEN 'group-skipped' ELSE own END AS status FROM ok WHERE claim_id % 5 <> 0)
SELECT one.claim_id, one.dest AS pathname, two.status, CASE WHEN two.status = 'emitted' THEN '"' || sha256(two.body) || '"' END AS etag, CASE WHEN two.status = 'emitted' THEN strlen(two.body) END AS bytes,
  CASE WHEN two.status = 'emitted' THEN '"' || sha256(two.body) || '"' WHEN two.status IS NOT NULL AND one.status = 'emitted' THEN '"' || sha256(one.body) || '"' END AS file_etag
FROM one LEFT JOIN two USING (claim_id)""",
    "composed_edits": """
WITH a AS (SELECT page_id, '<!--a-->' || substr(html, 1, 10) || substr(html, 21) AS t FROM pages),
b AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(t, 1, 5) || 'XY' || substr(t, 16) ELSE t END AS t, CASE WHEN page_id % 3 = 0 THEN 20 ELSE 28 END AS pos FROM a),
c AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN substr(t, 1, pos) || CASE WHEN page_id % 4 = 0 THEN '#' ELSE '' END || substr(t, pos + 11) ELSE t END AS t FROM b)
SELECT page_id, length(t) AS n_chars, sha256(t) AS sha256, NULL AS fault FROM c""",
    "loaded_catalogs": """
WITH d AS (SELECT lang, doc_id, '/' || lang || '/' || (doc_id % 300) AS path FROM documents),
good AS (SELECT * FROM d WHERE doc_id % 9 <> 0)
SELECT lang AS catalog, count(DISTINCT path) AS n, 0::BIGINT AS n_text FROM good GROUP BY lang
UNION ALL SELECT 'catalog-load-failed', 1, 0 UNION ALL SELECT 'catalog-missing-list-pages', 1, 0
UNION ALL SELECT 'catalog-invalid-pathname', count(*), 0 FROM d WHERE doc_id % 9 = 0
UNION ALL SELECT 'catalog-path-conflict', n, 0 FROM (SELECT count(*) - count(DISTINCT path) AS n FROM good) WHERE n > 0""",
    "broken_descriptors": f"SELECT doc_id, CASE doc_id % {len(_FAULTS)} " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_POINTERS) if p) + " END AS pointer FROM documents",
    "reconciled_graphs": f"""WITH s AS ({_SIDES})
SELECT '/n/' || k AS pathname, k % 5 IN (0, 2) AS managed_changed, k % 5 IN (1, 2, 3) AS whole_changed, CASE WHEN k % 5 = 3 THEN 'managed-graph-not-additive' END AS code,
  orgs + CASE WHEN k % 5 < 3 THEN 1 ELSE 0 END AS n_managed, orgs + 1 + CASE WHEN k % 5 < 3 THEN 1 ELSE 0 END AS n_whole, CASE WHEN k % 5 < 3 THEN 1 ELSE 0 END AS n_patch FROM s""",
    "site_references": """
SELECT DISTINCT 'schema.unresolved-reference' AS code, 'error' AS severity, 'https://graph.example/r/' || (s_suppkey % 9) AS entity_id, '/location/@id' AS pointer FROM supplier WHERE s_suppkey % 9 NOT IN (SELECT r_regionkey FROM region)
UNION ALL
SELECT 'schema.scalar-conflict', 'error', id, pointer FROM (
  WITH t AS (SELECT DISTINCT s_suppkey % 60 AS k, 'Org' AS name, s_suppkey % 9 AS r FROM supplier UNION SELECT DISTINCT s_suppkey % 60, 'Other', s_suppkey % 9 FROM supplier WHERE s_suppkey % 20 = 4),
  n AS (SELECT k, count(*) AS texts, count(DISTINCT r) AS places, count(DISTINCT name) AS names FROM t GROUP BY k),
  f AS (SELECT t.k, t.r, t.name, first_value(t.r) OVER w AS r0, first_value(t.name) OVER w AS name0 FROM t WINDOW w AS (PARTITION BY k ORDER BY name, r))
  SELECT 'https://graph.example/s/' || k AS id, unnest(list_filter([CASE WHEN name <> name0 THEN '/name' END, CASE WHEN r <> r0 THEN '/location/@id' END], lambda x: x IS NOT NULL)) AS pointer FROM f)""",
    "entity_positions": "SELECT '/n/' || s_nationkey AS pathname, s_suppkey::INT AS ord, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 60 || '', s_suppkey % 9, s_suppkey)::INT AS place FROM supplier",
    "plugin_artifact_plan": inputs.BASE + """,
s AS (SELECT site, 'PAGES: ' || count(DISTINCT pathname) AS body, bool_or(page_id % 2 = 0) AS routed FROM base GROUP BY site)
SELECT site, '/counts.txt' AS pathname, 'counts' AS owner, CASE WHEN routed THEN 'group-skipped' ELSE 'emit' END AS status, body FROM s
UNION ALL SELECT site, '/owned.txt', 'counts', CASE WHEN routed THEN 'replaced' ELSE 'emit' END, body FROM s
UNION ALL SELECT site, '/kept.txt', 'counts', CASE WHEN routed THEN 'preserved' ELSE 'emit' END, body FROM s
UNION ALL SELECT site, '/late.txt', 'breaks', 'plugin-artifact-missing', NULL FROM s
UNION ALL SELECT '-', '-', 'breaks', 'plugin-failed', NULL""",
    "stated_heads": """
WITH p AS (SELECT page_id, regexp_replace(html, '<title>.*?</title>', '') AS html, 'New ' || page_id || ' &amp; more' AS t FROM pages)
SELECT page_id, sha256(replace(html, '</head>', '<title>' || t || '</title><meta name="robots" content="noindex, nofollow">' || CASE WHEN page_id % 2 = 0 THEN '<meta property="og:type" content="article"><meta property="og:title" content="' || t ||
  '"><meta property="og:url" content="https://e.com/p/' || page_id || '"><meta property="og:image" content="https://e.com/i.png">' ELSE '' END || '</head>')) AS sha256 FROM p""",
    "represented_responses": f"""
WITH p AS (SELECT page_id AS k, {_LISTED}[page_id % {len(_TYPES)} + 1] AS kind, CASE WHEN page_id % 11 <> 0 THEN 'md ' || page_id END AS made, CASE WHEN page_id % 6 = 0 THEN 206 WHEN page_id % 6 = 1 THEN 404 ELSE 200 END AS up FROM pages),
r AS (SELECT *, made IS NOT NULL AND k % {len(_TYPES)} IN (0, 1, 2, 6) AND k % 5 <> 1 AS replaced, '"' || sha256(made) || '"' AS etag FROM p),
s AS (SELECT *, CASE WHEN NOT replaced THEN up WHEN up <> 404 AND k % 4 = 0 THEN 304 WHEN up = 206 THEN 200 ELSE up END AS status FROM r)
SELECT k AS request_id, replaced, status, CASE WHEN NOT replaced THEN CASE k % 5 WHEN 1 THEN 'content-encoding=gzip|' WHEN 2 THEN 'content-encoding=Identity|' ELSE '' END || 'content-type=' || kind || '|last-modified=then|x-kept=1'
  WHEN status = 304 THEN 'etag=' || etag || '|x-kept=1' ELSE 'content-type=text/markdown|etag=' || etag || '|x-kept=1' END AS headers,
  CASE WHEN NOT replaced THEN 'upstream' WHEN status = 304 OR k % 3 = 0 THEN NULL ELSE made END AS body FROM s""",
    "marked_pages": """
SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) THEN 'M ' || page_id END AS title,
  CASE page_id % 4 WHEN 0 THEN 'marker-repeated' WHEN 1 THEN 'marker-invalid,marker-invalid' WHEN 2 THEN 'marker-invalid,marker-repeated,marker-invalid,marker-repeated,marker-repeated' ELSE '' END AS codes, sha256(html) AS sha256 FROM pages""",
    "page_places": inputs.BASE + """,
n AS (SELECT site, page_id AS page_ord, CASE WHEN page_id % 3 = 0 THEN upper(translate(page_id::VARCHAR, '0123456789', 'abcdefghij')) ELSE translate(page_id::VARCHAR, '0123456789', 'abcdefghij') END AS name FROM base)
SELECT site, page_ord, name, row_number() OVER (PARTITION BY site ORDER BY lower(name))::INT AS place FROM n""",
    "artifact_requests": inputs.BASE + """,
a AS (SELECT page_id AS request_id, site, CASE page_id % 7 WHEN 0 THEN '/llms.txt' WHEN 1 THEN '/llms-full.txt' WHEN 2 THEN '/robots.txt' WHEN 3 THEN '/.well-known/domain-profile.json' WHEN 4 THEN '/p' || page_id || '.md' ELSE pathname END AS path FROM base)
SELECT request_id, path, CASE request_id % 7 WHEN 0 THEN 'index' WHEN 1 THEN 'full' WHEN 2 THEN 'robots' WHEN 3 THEN 'profile' WHEN 4 THEN 'markdown' END AS artifact,
  CASE WHEN request_id % 7 < 3 THEN 200 ELSE 404 END AS status, CASE WHEN request_id % 7 < 3 THEN site || path END AS body FROM a""",
    "read_manifests": "SELECT 'parts.example' AS site, '/a' || p_partkey AS pathname, 'core' AS owner, 'emitted' AS status, 1 AS version FROM part WHERE p_partkey % 5 > 1 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0",
    "replayed_patches": """SELECT '/n/' || s_nationkey AS pathname, count(*) FILTER (s_suppkey % 5 = 2) AS conflicts, count(*) FILTER (s_suppkey % 5 <> 0) AS entries, count(*) FILTER (s_suppkey % 5 = 1) AS firms
FROM supplier GROUP BY s_nationkey HAVING count(*) FILTER (s_suppkey % 5 <> 0) > 0""",
}
