from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitegrain.functions import paths, text


def values(spark, column, *inputs):
    rows = [(k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(inputs)]
    names = ["k", *"abcd"[: len(rows[0]) - 1]]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'k' else 'string'}" for n in names))
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def test_normalize(spark):
    assert values(spark, paths.normalize_path(F.col("a")), "", "/", "a", "/a/", "/a//", None) == ["/", "/", "/a", "/a", "/a/", None]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [
        ("/blog/**", "/blog", True), ("/blog/**", "/blog/a/b", True), ("/blog/**", "/blogs", False), ("/a/*", "/a/b", True), ("/a/*", "/a/b/c", False), ("/a", "/a/", True),
        ("**/x.html", "/p/q/x.html", True), ("/a?c", "/abc", True), ("/a?c", "/a/c", False), ("/[ab]*", "/beta", True), ("/[!ab]*", "/beta", False), ("/a.b", "/axb", False),
        ("/a*", "/a\n", True), ("**", "/anything/else", True),
    ],
)
def test_globs(spark, glob, path, hit):
    assert values(spark, paths.match_path(F.col("a"), glob), path) == [hit]


def test_include_exclude(spark):
    assert values(spark, paths.is_included(F.col("a"), ["/a/**"], ["/a/b/**"]), "/a", "/a/b", "/a/b/c", "/c") == [True, False, False, False]


def test_catalog_paths():
    bad = ["a", "//a", "/a/../b", "/a/%2e%2e/b", "/a%2Fb", "/a?b", "/a#b", "/a\\b", "/a%00", "/a%5Cb", "/a%25252e", "/%zz", "/a\nb", "/%ff", None]
    assert [paths.catalog_path(p) for p in bad] == [None] * len(bad)
    assert [paths.catalog_path(p) for p in ("/", "/a/", "/a%20b", "/é", "/a//b", "/100%25")] == ["/", "/a", "/a%20b", "/é", "/a//b", "/100%25"]
    assert paths.inspect_path("/a%20b") == "/a b"
    assert paths.exact_path("/a b") is None and paths.exact_path("/a%20b") == {"path": "/a%20b", "key": "/a b"}


def test_urls():
    cases = {
        ("HTTP://EXAMPLE.org:80/a/../b#x", None): "http://example.org/b", ("//x.com/y", "https://e.com"): "https://x.com/y", ("../z?q", "https://e.com/a/b/c"): "https://e.com/a/z?q",
        ("?x", "https://e.com/a"): "https://e.com/a?x", ("", "https://e.com/a?q#f"): "https://e.com/a?q", ("https://e.com", None): "https://e.com/", ("https://e.com:8443/%7e a", None): "https://e.com:8443/%7e%20a",
        ("http://localhost/", None): None, ("http://127.9.9.9/", None): None, ("http://[::1]/", None): None, ("mailto:a@b", None): None, ("https://u:p@e.com", None): None, ("/a", None): None, (None, None): None,
        ("https://e.com/./a/./", None): "https://e.com/a/", ("http:\\\\e.com\\a", None): "http://e.com/a",
    }
    assert {k: paths.stable_canonical(*k) for k in cases} == cases
    assert paths.entity_id("#a", "https://e.com/x") == "https://e.com/x#a"
    assert paths.entity_id("javascript:alert(1)") is None and paths.entity_id("urn:x:1") == "urn:x:1"
    assert paths.configured_canonical("https://e.com", "/b/", "/p", "always") == "https://e.com/b/p/"
    assert paths.within_site("https://e.com/b/x", "https://e.com/b/") and not paths.within_site("https://e.com/bx", "https://e.com/b/")


def test_loopback_and_schemes(spark):
    hosts = ["localhost", "a.localhost.", "127.0.0.1", "[::1]", "::ffff:127.0.0.1", "::ffff:7f00:1", "128.0.0.1", "localhost.com"]
    assert values(spark, paths.is_loopback(F.col("a")), *hosts) == [True] * 6 + [False] * 2
    assert values(spark, paths.is_unsafe_protocol(F.col("a")), "java\nscript:x", "mailto:a", "/x", "data:x") == [True, False, False, True]
    assert values(spark, paths.looks_like_url(F.col("a")), "https://x", "a b:c", "./x", "name", "#f") == [True, False, True, False, True]


def test_paths_of_artifacts(spark):
    assert values(spark, paths.page_of_md(F.col("a")), "/index.md", "/a.md", "/a") == ["/", "/a", None]
    assert values(spark, paths.strip_base(F.col("a"), "/b/"), "/b", "/b/x", "/bx") == ["/", "/x", None]
    assert values(spark, paths.file_of_page(F.col("a")), "/", "/a", "/404") == ["/index.html", "/a/index.html", "/404.html"]
    assert values(spark, paths.page_of_file(F.col("a")), "/index.html", "/a/index.html", "/b.html") == ["/", "/a", "/b"]


def test_text(spark):
    assert values(spark, text.decode_entities(F.col("a")), "&amp;lt; &#39;&nbsp;x", None) == ["&lt; ' x", None]
    assert values(spark, text.strip_title_suffix(F.col("a"), ["My (Site)", "X"]), "Page | My (Site)", "Page – X ", "X", "A - Y") == ["Page", "Page", "X", "A - Y"]
    assert values(spark, F.array_join(text.tokens(F.col("a")), "|"), " Skip, no-llms\tSKIP ", None, "") == ["skip|no-llms", "", ""]
    assert values(spark, text.iso_timestamp(F.col("a")), "2024-01-02", "2024-01-02T03:04:05+02:00", "Tue, 02 Jan 2024 03:04:05 GMT", "no") == [
        "2024-01-02T00:00:00.000Z", "2024-01-02T01:04:05.000Z", "2024-01-02T03:04:05.000Z", None,
    ]
    assert values(spark, text.is_rfc3339(F.col("a")), "2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z", "2024-01-01", "2024-01-01T24:00:00Z") == [True, False, False, False]
    assert values(spark, text.is_full_date(F.col("a")), "2024-02-29", "2023-02-29", "x") == [True, False, False]
    assert values(spark, text.json_string(F.col("a")), 'a"b\\c\n é/') == ['"a\\"b\\\\c\\n é/"']
    assert values(spark, text.escape_xml(F.col("a")), "a\x01<b>&'\"") == ["a&lt;b&gt;&amp;&apos;&quot;"]
    assert values(spark, text.strip_frontmatter(F.col("a")), "---\na: 1\n---\nbody", "no --- here") == ["body", "no --- here"]
    assert values(spark, text.merge_header(F.col("a"), "Accept"), None, "Cookie", "accept, Cookie") == ["Accept", "Cookie, Accept", "accept, Cookie"]
    assert values(spark, text.source_kind(F.col("a"), F.lit(False)), "cms:1", "a.MDX", "a.md?x", "a.astro", "a.txt", None) == ["cms", "mdx", "markdown", "astro", "custom", "rendered"]
