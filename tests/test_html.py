from __future__ import annotations

import pytest

from sitegrain.functions import accept
from sitegrain.functions.html import dom, scanner
from sitegrain.functions.html.markdown import Options, extract
from sitegrain.operators import heads, plugins


def md(body, **options):
    return extract(f"<main>{body}</main>", Options(**options), "https://e.com/a/b")["markdown"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<h1>T <em>x</em></h1><p>a <b>b</b>  c_d<br>e</p>", "# T _x_\n\na **b** c\\_d  \ne"),
        ("<ul><li>one<ul><li>two</li></ul></li><li>three</li></ul>", "-   one\n    -   two\n-   three"),
        ("<ol start=3><li>a<li>b</ol>", "3.  a\n4.  b"),
        ("<pre><code class='language-py'>x=1\n</code></pre>", "```py\nx=1\n```"),
        ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n> \n> r"),
        ("<p><a href='/z'>l</a> <img src='i.png' aria-label='lab'></p>", "[l](https://e.com/z) ![lab](https://e.com/a/i.png)"),
        ("<p>x <code>a`b</code></p><hr>", "x ``a`b``\n\n* * *"),
        ("<p onclick=x>a<script>s</script><style>t</style></p><nav>n</nav>", "a"),
        ("<p><a href='javascript:x'>j</a><a href='/y' title='T'></a></p>", "j[T](https://e.com/y \"T\")"),
        ("<table><tr><td>1</td></tr></table>", "<table><tr><td>1</td></tr></table>"),
        ("<p>1. a</p><p># b</p><p>- c</p><p>*d* [e]</p>", "1\\. a\n\n\\# b\n\n\\- c\n\n\\*d\\* \\[e\\]"),
        ("", ""),
    ],
)
def test_markdown(body, want):
    assert md(body) == want


def test_roots_and_fallbacks():
    page = "<body><div class=c>one<div class=c>in</div></div><div class=c>two</div><footer class=c>no</footer></body>"
    got = extract(page, Options(selectors=("#none", ".c"), remove=("footer",)))
    assert (got["strategy"], got["selected_nodes"], got["fallback_reason"]) == (".c", 2, None)
    assert got["markdown"] == "one\n\nin\n\ntwo"
    got = extract("<p>hi", Options(selectors=("#x",)))
    assert (got["markdown"], got["strategy"], got["fallback_reason"]) == ("hi", "body", "selectors-unmatched")
    assert extract("", Options())["strategy"] == "document"
    with pytest.raises(ValueError):
        Options(selectors=("a[",))


def test_scanner_skips_raw_text_and_comments():
    page = "<!-- <title>no</title> --><head><script>'<title>x</title>'</script><title> A &amp; B </title><META Name=Robots CONTENT='NoIndex'></head><body><title>late</title>"
    got = scanner.head_features(page)
    assert got["title"] == "A & B" and got["robots"] == "NoIndex"
    assert scanner.head_features("<meta name=description><meta name=description content=x>")["description"] is None
    assert scanner.head_features("<meta http-equiv=Refresh content=0>")["refresh"]
    assert scanner.head_features("<title>open")["title"] == "open"
    assert scanner.head_features("")["title"] == ""


def test_head_edits_leave_the_rest():
    page = "<html><head><title>t</title><link rel=canonical href='/a'></head><body><head></head>x"
    assert scanner.insert_into_head(page, "<x>") == page.replace("</head><body>", "<x></head><body>")
    assert scanner.insert_into_head("no head", "<x>") == "no head"
    out = heads.with_alternate(page, "/a.md")
    assert heads.with_alternate(out, "/b.md") == out and 'href="/b.md"' in heads.with_alternate(out, "/b.md", "always")
    assert heads.canonical_of(page, "https://e.com/") == ("https://e.com/a", False)
    assert heads.canonical_of(page.replace("</head><body>", "<link rel=canonical href=/b></head><body>"), "https://e.com/") == (None, True)
    managed = heads.with_managed(heads.with_managed(page, "{}"), '{"a":1}')
    assert managed.count(heads.MANAGED) == 1 and heads.without_managed(managed) == page
    filled = heads.fill_head(page, {"title": "T", "canonical": "https://e.com/a", "description": "d"})
    assert filled.count("canonical") == 1 and '<meta property="og:title" content="T">' in filled
    assert heads.fill_head(filled, {"title": "T", "canonical": "https://e.com/a", "description": "d"}) == filled
    assert "<title>New &amp; more</title>" in heads.replace_head(page, {"title": "New & more"})
    assert heads.marker("<script data-m>no</script><script data-m>{\"a\":1}</script>", "data-m") == {"a": 1}
    assert heads.strip_markers("a<script data-m>{}</script>b", "data-m") == "ab"


def test_delta():
    assert heads.delta("a b c", "a X c", "0 a b c 1") == "0 a X c 1"
    assert heads.delta("a b c", "a X c", "b b") is None
    assert heads.delta("a", "a", "z") == "z"


def test_breadcrumbs():
    page = '<nav aria-label="Breadcrumb"><a href="/">Home</a><a href="/x/">X</a></nav>'
    assert [s["name"] for s in heads.breadcrumb_trail(page, "https://e.com/x")] == ["Home", "X"]
    assert heads.breadcrumb_trail(page, "https://e.com/y") is None


def test_plain_text_and_selectors():
    root = dom.parse("pre<body><p>a<p>b <i>c</i><script>no</script><ul><li>d<li>e</ul>")
    assert dom.plain_text(root) == "a b c d e"
    root = dom.parse("<div id=x class='a b'><p data-k=v>1</p><p>2</p></div><span>3</span>")
    count = lambda s: len(dom.select(root, s))
    assert [count(s) for s in ("p", "div > p", "#x .q, span", ".a.b", "[data-k]", "p:not([data-k])", "p + p", "div ~ span", "p:first-child", "*")] == [2, 2, 1, 1, 1, 1, 1, 1, 1, 5]
    for bad in ("", " ", "a[", "p:nope", ">"):
        with pytest.raises(ValueError):
            dom.selector(bad)


@pytest.mark.parametrize(
    ("header", "want"),
    [
        ("text/markdown", True), ("text/html,text/markdown;q=0.5", False), ("*/*", False), ("text/markdown;q=0.9,text/html;q=0.8", True), ("text/*", False), (None, False), ("", False),
        ('text/markdown;charset="UTF-8",*/*;q=0.1', True), ("text/markdown;charset=latin1", False), ("text/markdown;q=0", False), ("text/markdown;q=2", False), ("bad", False), ('text/markdown;x="a', False),
        ("text/markdown, text/html;charset=utf-8", False), ("text/markdown;q=0.5;ext=1", True), ("text/markdown,", False), (",text/markdown", False), ("text/markdown;", False),
        ("text/markdown;q=1;q=1", False), ("text/markdown;a=1;A=2", False), ('text/markdown ; charset = "utf\\-8" , */*;q=0.1', True), ("text/markdown;q=1.000", True), ("text/markdown x", False),
    ],
)
def test_accept(header, want):
    assert accept.prefers_markdown(header) is want


def test_names_of_images_and_links():
    page = "<main><a href=/a><img src=x aria-labelledby='n m'></a><a href=/b title=' T '></a><a href=/c>shown</a><a href=/d aria-label=L><img src=y></a><i id=n>N</i><b id=m> M </b><img src=z title=Z></main>"
    got = extract(page)["markdown"]
    for part in ("[![N M](x)](/a)", '[T](/b " T ")', "[shown](/c)", "[L](/d)", '![Z](z "Z")'):
        assert part in got


def test_content_roots_are_the_outermost_of_the_first_selector_that_matches():
    page = "<body><article>one<article>in</article></article><nav><article>no</article></nav><article>two</article><p role=main>three</p></body>"
    got = extract(page)
    assert (got["strategy"], got["selected_nodes"]) == ("article", 2) and "one" in got["markdown"] and "two" in got["markdown"] and "no" not in got["markdown"].split()
    assert extract("", Options(selectors=()))["fallback_reason"] == "no-selectors+empty-body"


class Failing:
    name, api_version = "failing", 1

    def render(self, page):
        raise RuntimeError("secret")


class Fixed:
    name, api_version = "fixed", 1

    def render(self, page):
        return {"status": "rendered", "markdown": "ok"}


def test_renderers(spark):
    assert plugins.render_chain({}, [Failing(), Fixed()]) == {"markdown": "ok", "renderer": "fixed", "status": "rendered", "codes": "renderer-failed"}
    got = plugins.render_chain({"kind": "mdx", "body": "import X from 'x'\n\n# A\n<Box>b</Box> `{c}`"}, [plugins.MdxRenderer(components={"Box": {"action": "unwrap"}})])
    assert got["markdown"] == "\n# A\nb `{c}`"
    assert plugins.render_chain({"kind": "mdx", "body": "{x}"}, [plugins.MdxRenderer()])["status"] == "fallback-to-html"
    with pytest.raises(ValueError):
        plugins.check_renderer(object())


def test_stages_isolate_failures(spark):
    def fail(df):
        raise RuntimeError("secret")

    chain = plugins.Dispatcher([plugins.Plugin("a", {"transform": fail}), plugins.Plugin("b", {"transform": lambda df: df.drop("id")}), plugins.Plugin("c", {"transform": lambda df: df.withColumn("x", df.id + 1)})])
    out = chain.run("transform", spark.range(2))
    assert out.columns == ["id", "x"]
    assert chain.findings == [("a", "transform", "plugin-failed"), ("b", "transform", "plugin-invalid-result")]


def test_pages_nested_without_end():
    from sitegrain.functions.html import markdown

    assert markdown.extract("<div>" * 2000 + "x")["markdown"] == "x"
    assert markdown.extract("<ul><li>" * 300 + "x")["markdown"].strip().endswith("-   x")
    assert markdown.extract("<ul><ul><li>a</li></ul><pre>b</pre></ul>")["output_characters"] > 0


def test_no_content_inside_a_barred_document_element():
    from sitegrain.functions.html import markdown

    barred = markdown.Options(remove=(".off",))
    found = markdown.extract('<html class="off"><body><main>a</main></body></html>', barred)
    assert (found["strategy"], found["markdown"]) == ("document", "")
    assert markdown.extract("<html><body>a</body></html>", markdown.Options(selectors=("html",)))["strategy"] == "html"


def test_names_and_other_selectors_in_one_list():
    from sitegrain.functions.html import dom

    root = dom.parse("<body><nav>1</nav><p class=x>2</p><P>3</P></body>")
    assert [n.text() for n in dom.select(root, "NAV, .x")] == ["1", "2"]
    assert [n.text() for n in dom.select(root, "nav,p")] == ["1", "2", "3"]
