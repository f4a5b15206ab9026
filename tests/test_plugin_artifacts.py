"""Plugins that claim artifacts: registration, hooks that fail late, requests, sections by predicate."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitegrain.config import Section
from sitegrain.functions import accept
from sitegrain.operators import corpus, ownership, plugin_artifacts
from sitegrain.operators.plugin_artifacts import GENERATE, VALIDATE, ArtifactPlugin, Claim, ClaimError


def counting(claims, pages):
    n = pages.groupBy("site").agg(F.count("*").alias("n"))
    own = F.col("plugin") == "counts"
    out = claims.join(n, "site", "left")
    return out.withColumns({"body": F.when(own, F.concat(F.lit("pages: "), "n")).otherwise(F.col("body")), "content_type": F.when(own, F.lit("text/plain")).otherwise(F.col("content_type"))}).drop("n")


def breaks_late(claims, pages):
    @F.udf("string")
    def no(_):
        raise RuntimeError("late")

    return claims.withColumn("body", no("site"))


def shouting(claims, pages):
    return claims.withColumn("body", F.upper("body"))


PLUGINS = [
    ArtifactPlugin("late", (Claim("x", "/late.txt"),), {GENERATE: breaks_late}),
    ArtifactPlugin("counts", (Claim("a", "/counts.txt"), Claim("b", "/owned.txt", replace=True), Claim("c", "/kept.txt")), {GENERATE: counting}),
    ArtifactPlugin("loud", (), {VALIDATE: shouting}),
    ArtifactPlugin("adds", (), {VALIDATE: lambda claims, pages: claims.withColumn("served_key", F.lit("/else"))}),
    ArtifactPlugin("lazy", (Claim("z", "/lazy.txt"),), {VALIDATE: lambda claims, pages: None}),
    ArtifactPlugin("wrong", (), {VALIDATE: lambda claims, pages: claims.drop("body")}),
]


@pytest.fixture(scope="module")
def produced(spark):
    pages = spark.createDataFrame([("s", "/a", "secret"), ("s", "/b", "secret"), ("s", "../c", "x"), ("t", "/a", None)], "site string, pathname string, html string")
    return plugin_artifacts.produce(PLUGINS, pages)


def test_artifacts_of_plugins(spark, produced):
    got = {(r.site, r.dest): (r.owner_name, r.body) for r in produced.claims.collect()}
    assert got == {(s, d): ("counts", f"PAGES: {n}") for s, n in (("s", 2), ("t", 1)) for d in ("/counts.txt", "/owned.txt", "/kept.txt")}
    found = sorted((r.site or "", r.code, r.plugin) for r in produced.findings.collect())
    assert found == sorted([("", "plugin-failed", "late"), ("", "plugin-invalid-result", "adds"), ("", "plugin-invalid-result", "wrong")] + [(s, "plugin-artifact-missing", p) for s in "st" for p in ("late", "lazy")])
    routes = spark.createDataFrame([("s", "/owned.txt"), ("s", "/kept.txt")], "site string, pathname string")
    none = spark.createDataFrame([], "site string, dest string, kind string, etag string")
    plan = ownership.resolve(ownership.externally_owned(ownership.conflicts(produced.claims), routes, none))
    assert {(r.site, r.dest): r.status for r in plan.collect()} == {("s", "/counts.txt"): "emit", ("s", "/owned.txt"): "replaced", ("s", "/kept.txt"): "preserved", ("t", "/counts.txt"): "emit", ("t", "/owned.txt"): "emit", ("t", "/kept.txt"): "emit"}


def test_requests(spark, produced):
    asked = spark.createDataFrame([(1, "/counts.txt", "GET"), (2, "/counts.txt", "HEAD"), (3, "/counts.txt", "POST"), (4, "/owned.txt", "GET"), (5, "/kept.txt", "GET"), (6, "/none", "GET")], "request_id int, path string, method string").withColumn("site", F.lit("s"))
    routes = spark.createDataFrame([("s", "/owned.txt"), ("s", "/kept.txt")], "site string, pathname string")
    core = spark.createDataFrame([], "site string, path string")
    got = {r.request_id: (r.status, r.body) for r in plugin_artifacts.answer(asked, produced.claims, core, routes).collect()}
    assert got == {1: (200, "PAGES: 2"), 2: (200, None), 3: (None, None), 4: (200, "PAGES: 2"), 5: (None, None), 6: (None, None)}
    core = spark.createDataFrame([("s", "/counts.txt")], "site string, path string")
    twice = produced.claims.unionByName(produced.claims.where("dest = '/owned.txt'").withColumn("claim_id", F.lit(99)))
    got = {r.request_id: r.status for r in plugin_artifacts.answer(asked, twice, core, routes).collect()}
    assert got == {1: 500, 2: 500, 3: None, 4: 500, 5: None, 6: None}


def test_registration():
    plugin_artifacts.check_plugins(PLUGINS)
    good = Claim("a", "/x.txt")
    for bad in (
        [ArtifactPlugin("")], [ArtifactPlugin("Bad Name")], [ArtifactPlugin("a"), ArtifactPlugin("a")], [ArtifactPlugin("a", api_version=2)], [ArtifactPlugin("a", (good, good))], [ArtifactPlugin("a", (Claim(" ", "/x"),))],
        [ArtifactPlugin("a", (Claim("a", "x"),))], [ArtifactPlugin("a", (Claim("a", "/a/../b"),))], [ArtifactPlugin("a", (Claim("a", "/a*"),))], [ArtifactPlugin("a", (Claim("a", "/x", replace=1),))], [ArtifactPlugin("a", (), {"graph:build": counting})],
    ):
        with pytest.raises(ClaimError):
            plugin_artifacts.check_plugins(bad)


def test_pages_shown_to_plugins(spark):
    rows = spark.createDataFrame([("s", "b", "/p", "<html>", "weird", "md"), ("s", "a", "/p", "<html>", "prerendered", "md1"), ("s", "c", "//x", "<html>", None, None)], "site string, id string, pathname string, html string, rendering string, markdown string")
    got = plugin_artifacts.safe_pages(rows)
    assert "html" not in got.columns and [tuple(r) for r in got.collect()] == [("s", "a", "/p", "prerendered", "md1")]


def test_sections_by_predicate(spark):
    df = spark.createDataFrame([("/a", 3), ("/blog/x", 1), ("/c", None), ("/d", 9)], "pathname string, score int")
    sections = (Section("Blog", ("/blog/**",)), Section("High", where=F.col("score") > 5), Section("Some", where=lambda rows: rows.score.isNotNull()))
    title, rank = corpus.section_of(F.col("pathname"), sections, "Other", df)
    assert [tuple(r) for r in df.select(title, rank).collect()] == [("Some", 2), ("Blog", 0), ("Other", 3), ("High", 1)]


@pytest.mark.parametrize("header", ["text/é", "text/markdown;q=0.٣", "text/markdown;q=٠", 'text/markdown;x="\x01"', 'text/markdown;x="a\\\x02"', "text/märkdown, text/markdown"])
def test_accept_is_ascii(header):
    assert accept.parse(header) is None and accept.prefers_markdown(header) is False
