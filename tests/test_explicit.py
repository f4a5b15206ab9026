"""Heads that pages state themselves."""

from __future__ import annotations

import json

from sitegrain.functions.html import scanner
from sitegrain.operators import explicit, heads

PAGE = (
    '<html><head><title>Old</title><meta name="description" content="old"><link rel="canonical" href="https://e.com/old"><meta name="robots" content="index"><meta property="og:title" content="o"><meta property="OG:video" content="v">'
    '<meta name="twitter:card" content="c"><link rel="alternate" hreflang="de" href="/de"><link rel="alternate" type="application/rss+xml" href="/r"><link rel="prev" href="/0"><meta name="theme-color" content="red"><meta name="author" content="A">'
    '<link rel="alternate" type="text/markdown" href="/o.md"><meta name="viewport" content="w"></head><body><title>not this</title></body></html>'
)
HERE, SITE = "https://e.com/p", "https://e.com/"


def head(said, page=PAGE):
    text, codes = explicit.state(page, said, HERE, SITE)
    return text, codes


def test_only_families_that_are_spoken_of_change():
    assert head({}) == (PAGE, [])
    text, _ = head({"title": "A & <b>"})
    assert text == PAGE.replace("<title>Old</title>", "").replace("</head>", "<title>A &amp; &lt;b&gt;</title></head>")
    text, _ = head({"robots": ["noindex", "nofollow"], "pagination": {"previous": "/1", "next": None}})
    assert '<meta name="robots" content="noindex, nofollow"><link rel="prev" href="https://e.com/1"></head>' in text and 'content="index"' not in text and "/0" not in text
    assert head({"title": 3, "openGraph": "x", "hreflang": {}, "twitter": None, "feeds": "x"}) == (PAGE, [])


def test_social_tags():
    said = {
        "title": "T", "locale": "en_GB",
        "openGraph": {"type": "article", "siteName": "S", "images": ["/a.png", {"url": "b.png", "secureUrl": "/s.png", "width": 10, "alt": 'x"y'}, {"url": "javascript:x"}], "localeAlternates": ["de_DE", 4]},
        "twitter": {"card": "player", "siteId": "1", "imageAlt": "alt", "player": {"url": "/pl", "width": 640, "height": 360.5, "stream": "/st"}, "apps": [{"platform": "ipad", "name": "N", "id": "7", "url": "https://e.com/app"}, {"platform": "other", "name": "N"}]},
    }
    text, codes = head(said)
    tags = [(a.get("property") or a.get("name"), a.get("content")) for _, a in scanner.head_tags(text, "meta")]
    assert [t for t in tags if t[0].startswith("og:")] == [
        ("og:type", "article"), ("og:title", "T"), ("og:url", HERE), ("og:site_name", "S"), ("og:locale", "en_GB"), ("og:image", "https://e.com/a.png"), ("og:image", "https://e.com/b.png"),
        ("og:image:secure_url", "https://e.com/s.png"), ("og:image:width", "10"), ("og:image:alt", "x&quot;y"), ("og:locale:alternate", "de_DE"),
    ]
    assert [t for t in tags if t[0].startswith("twitter:")] == [
        ("twitter:card", "player"), ("twitter:site:id", "1"), ("twitter:title", "T"), ("twitter:image", "https://e.com/a.png"), ("twitter:image:alt", "alt"), ("twitter:player", "https://e.com/pl"), ("twitter:player:width", "640"),
        ("twitter:player:height", "360.5"), ("twitter:player:stream", "https://e.com/st"), ("twitter:app:name:ipad", "N"), ("twitter:app:id:ipad", "7"), ("twitter:app:url:ipad", "https://e.com/app"),
    ]
    assert codes == [] and ("viewport", "w") in tags


def test_links_colours_authors():
    said = {
        "canonical": "/x", "hreflang": [{"lang": "fr", "href": "/fr"}, {"lang": "", "href": "/q"}, 3], "feeds": [{"href": "/f", "type": "application/atom+xml", "title": "F"}], "markdownAlternate": {"href": "/m.md", "title": "M"},
        "themeColor": ["#fff", {"color": "#000", "media": "(x: dark)"}], "author": ["A", {"name": "B", "url": "/b"}, {}],
    }
    text, _ = head(said)
    added = text[text.index('content="w">') + len('content="w">') : text.index("</head>")]
    assert added == (
        f'<link rel="canonical" href="{HERE}"><link rel="alternate" hreflang="fr" href="https://e.com/fr"><link rel="alternate" type="application/atom+xml" title="F" href="https://e.com/f">'
        '<link rel="alternate" type="text/markdown" title="M" href="https://e.com/m.md"><meta name="theme-color" content="#fff"><meta name="theme-color" content="#000" media="(x: dark)">'
        '<meta name="author" content="A"><meta name="author" content="B"><link rel="author" href="https://e.com/b">'
    )
    for gone in ("/old", "/de", '"/r"', "red", "/o.md"):
        assert gone not in text
    assert head({"locale": 3})[1] == ["head-locale-invalid"] and '<meta property="og:locale" content="fr">' in head({"locale": "fr"})[0]


def test_catalog_trails():
    steps = [{"name": "Home", "item": "https://e.com/"}, {"name": " ", "item": "https://e.com/a"}, {"name": "P", "item": "https://e.com/p#x"}]
    assert explicit.catalog_trail(steps, HERE) == [{"position": 1, "name": "Home", "item": "https://e.com/"}, {"position": 2, "name": "P", "item": HERE}]
    assert explicit.catalog_trail(steps[:2], HERE) is None and explicit.catalog_trail(steps, "https://e.com/q") is None and explicit.catalog_trail(None, HERE) is None


def test_enrichment_with_statements(spark):
    steps = [("Home", "https://e.com/"), ("P", "https://e.com/p")]
    rows = [("e.com", "/p", HERE, "/p.md", PAGE, "t", "d", "en", json.dumps({"title": "Stated", "canonical": "/p", "schema": {"@type": "Person", "name": "N"}}), steps), ("e.com", "/q", "https://e.com/q", "/q.md", "<html><head></head></html>", "t", "d", "en", "{", None), ("e.com", "/r", "https://e.com/r", "/r.md", "<html><head></head></html>", None, None, None, None, steps)]
    df = spark.createDataFrame(rows, "site string, pathname string, url string, md_href string, html string, title string, description string, language string, head string, trail array<struct<name:string,item:string>>")
    got = {r.pathname: r for r in heads.enrich(df).collect()}
    kinds = {p: {json.loads(e)["@type"] for e in r.entities} for p, r in got.items()}
    assert kinds == {"/p": {"Person", "WebSite", "WebPage", "BreadcrumbList"}, "/q": {"WebSite", "WebPage"}, "/r": {"WebSite", "WebPage"}}
    assert got["/p"].canonical == HERE and got["/p"].html.count("<title>Stated</title>") == 1 and "/old" not in got["/p"].html
    assert got["/q"].codes == ["head-invalid"] and got["/p"].codes == []
    assert any(json.loads(e).get("name") == "Stated" for e in got["/p"].entities)
    plain = heads.enrich(df.drop("head", "trail"))
    assert plain.count() == 3


def test_markers(spark):
    good, bad = "<script data-m>{\"a\": 1}</script>", "<script data-m>[</script>"
    assert heads.marker_payloads(f"<head>{bad}{good}</head><body>{good}x<script>data-m</script>", "data-m") == ({"a": 1}, ["marker-invalid", "marker-repeated"], "<head></head><body>x<script>data-m</script>")
    assert heads.marker_payloads(None, "data-m") == (None, [], None) and heads.marker_payloads("x", "data-m") == (None, [], "x")
    df = spark.createDataFrame([("s", "/a", f"<head>{good}</head>", 1), ("s", "/b", bad, 2), ("s", "/c", None, 3)], "site string, pathname string, html string, other int")
    pages, found = heads.marked(df, "data-m")
    assert {r.pathname: (r.marker, r.html, r.other) for r in pages.collect()} == {"/a": ('{"a":1}', "<head></head>", 1), "/b": (None, "", 2), "/c": (None, None, 3)}
    assert [(r.code, r.pathname) for r in found.collect()] == [("marker-invalid", "/b")]
