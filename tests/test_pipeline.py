from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitegrain.config import Corpus, Section, Site
from sitegrain.operators import corpus, ownership, records
from sitegrain.sources import pages as source
from sitegrain.sources import sinks
from sitegrain.streaming import pages as streaming

HTML = '<html lang="en"><head><title>{} | S</title>{}</head><body><main><h1>{}</h1></main></body></html>'


@pytest.fixture(scope="module")
def site_pages(spark):
    rows = [
        ("a.com", "/", 0, "https://a.com/", HTML.format("Home", '<meta name="description" content="D">', "Home")),
        ("a.com", "/b", 1, "https://a.com/b", HTML.format("B", '<meta name="aeo" content="no-dotmd">', "B")),
        ("a.com", "/b", 2, "https://a.com/b", HTML.format("again", "", "again")),
        ("a.com", "/c", 3, "https://a.com/c", HTML.format("C", '<meta name="robots" content="noindex">', "C")),
        ("a.com", "/d", 4, "https://a.com/d", HTML.format("D", '<meta name="aeo" content="no-llms-full">', "D")),
        ("b.com", "/x", 5, "https://b.com/x", None),
    ]
    return spark.createDataFrame(rows, "site string, pathname string, page_ord long, url string, html string")


def test_records(spark, site_pages):
    authored = spark.createDataFrame([("a.com", "/b", "", "own *text*", "2024-01-02")], "site string, pathname string, title string, markdown string, modified string")
    got = {(r.site, r.pathname): r for r in records.records(site_pages, Site(strip_title_suffix=("S",)), authored).collect()}
    assert ("a.com", "/c") not in got
    b = got["a.com", "/b"]
    assert (b.title, b.markdown, b.strategy, b.modified, b.md_href) == ("B", "own *text*", "markdown-route", "2024-01-02T00:00:00.000Z", "/b.md")
    assert got["a.com", "/"].description == "D" and got["a.com", "/"].markdown == "# Home" and got["a.com", "/"].url == "https://a.com/"
    assert got["a.com", "/d"].directives.includeInLlmsFull is False


def test_corpora(site_pages):
    site = Site(corpus=Corpus(sections=(Section("Sub", ("/?",)),), default_section="Main"), strip_title_suffix=("S",))
    rows = records.records(site_pages, site)
    index = {r.site: r.body for r in corpus.text_index(rows, site).collect()}
    assert index["a.com"] == "# Home\n\n## Sub\n\n- [D](/d.md)\n\n## Main\n\n- [Home](/index.md): D\n"
    html_too = site.but(corpus=Corpus(include_html_only=True))
    assert "- [B](https://a.com/b/)" in {r.site: r.body for r in corpus.text_index(rows, html_too).collect()}["a.com"]
    full = {r.site: r.body for r in corpus.full_corpus(rows, site).collect()}["a.com"]
    assert full.startswith("# Home\n\n---\n\n# Home\n\nURL: https://a.com/\nDescription: D\n\n# Home\n\n---\n") and "# D" not in full
    capped = site.but(corpus=Corpus(max_pages=2))
    assert {r.site for r in corpus.text_index(rows, capped).collect()} == {"b.com"}
    assert corpus.refused(rows, 2).first().n_pages == 3


def test_groups_are_all_or_none(spark):
    rows = [(1, "/a", "g", False, None, False), (2, "/b", "g", True, None, False), (3, "/c", None, False, "public-file", False), (4, "/d", None, False, "public-file", True)]
    df = spark.createDataFrame(rows, "claim_id int, dest string, grp string, conflict boolean, owner string, replace boolean").withColumn("site", F.lit("s"))
    assert {r.claim_id: r.status for r in ownership.resolve(df).collect()} == {1: "group-skipped", 2: "conflict", 3: "preserved", 4: "replaced"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", "/a.md", "text/markdown", "x"), ("s", "/b.md", "text/markdown", "y")], "site string, served_path string, content_type string, body string")
    sinks.write_artifacts(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_artifacts(df.union(df), str(tmp_path / "twice"))
    nested = df.selectExpr("site", "concat(served_path, '/x') AS dest").union(df.selectExpr("site", "served_path AS dest"))
    assert sinks.check_destinations(nested).count() == 2
    assert sinks.within_root("/r", "a/../b") == "/r/b"
    with pytest.raises(ValueError):
        sinks.within_root("/r", "../x")
    assert [sinks.sitemap_plan(*a) for a in (("auto", True, True), ("auto", False, True), ("always", False, False), ("disabled", True, True))] == ["expected", "register", "warn", "none"]


def test_file_sources(spark, tmp_path):
    for name, body in (("index.html", "<title>i</title>"), ("a/index.html", "<title>a</title>"), (".hid/x.html", ""), ("node_modules/y.html", ""), ("c.md", "---\nt: 1\n---\nbody")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    assert {r.pathname for r in source.built_pages(spark, str(tmp_path), "s").collect()} == {"/", "/a"}
    assert [(r.path, r.markdown, r.kind) for r in source.authored(spark, str(tmp_path)).collect()] == [("/c.md", "body", "markdown")]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.com/x", HTML.format("X", "", "X")), (2, "https://a.com/y/", HTML.format("Y", "", "Y"))], streaming.RAW).write.parquet(str(tmp_path / "in"))
    seen = []
    query = streaming.publish(streaming.stream(spark, str(tmp_path / "in")), Site(), lambda df, n: seen.extend(df.select("pathname", "title").collect()), str(tmp_path / "cp"))
    query.awaitTermination()
    assert sorted(map(tuple, seen)) == [("/x", "X | S"), ("/y", "Y | S")]
    now = spark.createDataFrame([("a", "/1", "t"), ("a", "/2", "u"), ("a", "/3", "v")], "site string, pathname string, etag string")
    old = spark.createDataFrame([("a", "/1", "t"), ("a", "/2", "x")], "site string, pathname string, etag string")
    assert {(r.pathname, r.change) for r in streaming.changes(now, old).collect()} == {("/2", "changed"), ("/3", "new")}
