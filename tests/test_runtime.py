from __future__ import annotations

import json

from pyspark.sql import functions as F

from sitegrain.functions import options
from sitegrain.operators import catalog, components, records, runtime


def test_responses(spark):
    artifacts = spark.createDataFrame([("s", "/a", "html"), ("s", "/a.md", "md"), ("s", "/llms.txt", "x")], "site string, served_path string, body string")
    tag = artifacts.filter("served_path = '/a'").select(F.concat(F.lit('"'), F.sha2("body", 256), F.lit('"')).alias("t")).first().t
    rows = [(1, "/a", "GET", "text/html", None), (2, "/a", "GET", "text/markdown", None), (3, "/a", "HEAD", None, None), (4, "/a", "GET", None, "W/" + tag), (5, "/zz", "GET", None, None), (6, "/llms.txt", "GET", "text/markdown", None)]
    asked = spark.createDataFrame([(i, "s", *r) for i, *r in rows], "request_id int, site string, path string, method string, accept string, if_none_match string")
    got = {r.request_id: (r.status, r.body, r.served_path) for r in runtime.respond(asked, artifacts).collect()}
    assert got == {1: (200, "html", "/a"), 2: (200, "md", "/a.md"), 3: (200, None, "/a"), 4: (304, None, "/a"), 5: (404, None, "/zz"), 6: (200, "x", "/llms.txt")}
    moved = {r.request_id: r.status for r in runtime.respond(asked, artifacts, "redirect").collect()}
    assert moved[2] == 303 and moved[1] == 200


def test_page_set_and_gates(spark):
    static = spark.createDataFrame([("s", "/a"), ("s", "/llms.txt")], "site string, pathname string")
    listed = spark.createDataFrame([("s", "/a", 1, "x"), ("s", "/a", 2, "y"), ("s", "/b", 3, None)], "site string, pathname string, row_ord int, title string")
    owned = spark.createDataFrame([("/llms.txt",)], "pathname string")
    assert {(r.pathname, r.title) for r in runtime.page_set(static, listed, owned).collect()} == {("/a", "y"), ("/b", None)}
    asked = spark.createDataFrame([("s", "/g"), ("s", "/m"), ("t", "/m")], "site string, path string")
    routes = spark.createDataFrame([("s", "/g")], "site string, pathname string")
    flagged = runtime.project_owned(asked, routes)
    assert {r.site: r.blocked for r in runtime.pair_gate(flagged, ("/g", "/m")).collect()} == {"s": True, "t": False}
    assert runtime.project_owned(asked, routes, [r"\A/m\z"]).filter("owned").count() == 3
    files = spark.createDataFrame([("s", "/a.xml")], "site string, href string")
    got = {r.site: (r.write_alias, r.advertise) for r in runtime.sitemaps(asked, files, "/a.xml", "/b.xml").collect()}
    assert got == {"s": (True, True), "t": (False, False)}
    found = spark.createDataFrame([("s", "a-b", "error", "secret"), ("s", "Bad Code", "error", "x"), ("s", "c", "fatal", "x")], "site string, code string, severity string, message string")
    assert [tuple(r) for r in runtime.diagnostics(found).collect()] == [("s", "a-b", "error")]


def test_components(spark):
    df = spark.createDataFrame([("s", "/p", 2, "q2", "a2"), ("s", "/p", 1, "q1", "a1")], "site string, pathname string, ord int, question string, answer string")
    made = json.loads(components.faq(df).first().entity)
    assert [q["name"] for q in made["mainEntity"]] == ["q1", "q2"]
    steps = json.loads(components.how_to(df.withColumnRenamed("question", "name").withColumnRenamed("answer", "text")).first().entity)
    assert [(s["position"], s["name"]) for s in steps["step"]] == [(1, "q1"), (2, "q2")]
    row = df.limit(1).select(
        components.article(F.lit("h"), F.lit("u"), F.lit(None).cast("string"), F.lit("m"), F.lit("n")).alias("a"), components.script(F.lit("</s\u2028")).alias("s"),
        components.descriptor_document(F.lit("<t>"), F.lit('"d"'), F.lit(None).cast("string")).alias("d"), components.organization(F.lit("n"), F.lit("u"), F.lit("https://e.com/"), F.lit(None).cast("string"), F.array(F.lit("x"))).alias("o"),
    ).first()
    assert json.loads(row.a)["author"]["name"] == "n" and "datePublished" not in json.loads(row.a)
    assert row.s == "\\u003c/s\\u2028" and "<title>&lt;t&gt;</title>" in row.d and 'content="&quot;d&quot;"' in row.d
    assert json.loads(row.o)["@id"] == "https://e.com/#organization"


def test_options():
    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    assert options.get(base, "a.b") == 1 and options.get(base, "a.x.y") is None
    assert options.put(base, "a.e.f", 3)["a"]["e"] == {"f": 3} and "e" not in base["a"]
    assert options.merge(base, {"a": {"b": 5}, "d": [2], "z": None}) == {"a": {"b": 5, "c": 2}, "d": [2], "z": None}
    assert options.lift({"old": 1, "x": 2, "y": 3}, {"old": "new.at", "x": "y"}) == ({"old": 1, "x": 2, "y": 3, "new": {"at": 1}}, ["x"])


def test_paths_owned_at_one_site_stay_at_others(spark):
    rows = spark.createDataFrame([("s", "/x", 1, "a"), ("t", "/x", 2, "b")], "site string, pathname string, row_ord int, title string")
    owned = spark.createDataFrame([("s", "/x")], "site string, pathname string")
    assert [r.site for r in runtime.page_set(rows.select("site", "pathname"), rows, owned).collect()] == ["t"]
    left, found = catalog.without_owned(rows, owned)
    assert [r.site for r in left.collect()] == ["t"] and [r.code for r in found.collect()] == ["catalog-path-owned"]


def test_site_order_is_that_of_a_locale(spark):
    urls = ["https://e/b", "https://e/A", "https://e/a", "https://e/é", "https://e/z", "https://e/f"]
    out = records.site_order(spark.createDataFrame([("s", u) for u in urls], "site string, canonical_url string"))
    assert [r.canonical_url[-1] for r in out.orderBy("place").collect()] == ["a", "A", "b", "é", "f", "z"]
