"""MDX read without being run."""

from __future__ import annotations

import pytest

from sitegrain.functions import mdx
from sitegrain.operators import plugins

ALL = {"Box": {"action": "unwrap"}, "Gone": {"action": "omit"}, "Note": {"action": "element", "name": "aside"}}


def render(body, components=ALL, **more):
    return plugins.MdxRenderer(components=components, **more).render({"kind": "mdx", "body": body})


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("# A\n\ntext", "# A\n\ntext"),
        ("import X from 'x'\nexport const a = {\n  b: '}',\n\n  c: `${1 + {}}`\n}\n\n# A\n", "\n# A\n"),
        ("text\nimport is a word\n", "text\nimport is a word\n"),
        ("a {/* gone */} b", "a  b"),
        ("{/* one */ /* } */}", ""),
        ("<Box>in *side*</Box> out", "in *side* out"),
        ("<Box a='>' b=\"x>y\" c>in</Box>", "in"),
        ("<Note kind='x'>\n\n**b**\n\n</Note>", "<aside>\n\n**b**\n\n</aside>"),
        ("<Note /> <Box/> <Note\n/>", "<aside></aside>  <aside></aside>"),
        ("<Gone>{run()} <Other x={1}/> <Gone>n</Gone></Gone>z", "z"),
        ("<script>{x}</script>a<div class='k'>b</div>", "a<div class='k'>b</div>"),
        ("<>f<Box><Box>g</Box></Box></>", "fg"),
        ("`{x}` ``<Y>`` \\{z \\<q", "`{x}` ``<Y>`` \\{z \\<q"),
        ("```js\n{x}\n<Y>\n```\nend", "```js\n{x}\n<Y>\n```\nend"),
        ("~~~\n```\n{x}\n~~~", "~~~\n```\n{x}\n~~~"),
    ],
)
def test_rendered(source, want):
    assert render(source) == {"status": "rendered", "markdown": want}


@pytest.mark.parametrize("source", ["{x}", "a {'}'} b", "<Box a={1}>x</Box>", "<Box {...p}>x</Box>", "<Other>x</Other>", "<a.b>x</a.b>", "{`${'}'}`}", "<div onClick={f}>x</div>"])
def test_fallback(source):
    assert render(source)["status"] == "fallback-to-html"


@pytest.mark.parametrize("source", ["<Box>", "</Box>", "<Box></Note>", "{", "{'", "<!-- c -->", "a < b", "<Box a=>x</Box>", "<Box /x>", "import x from 'y'\n# A", "{/* x }", "<Box", "{a)}", "export const a = ["])
def test_no_mdx(source):
    assert render(source) == {"status": "continue", "code": "mdx-parse-failed"}


@pytest.mark.parametrize("components", [[], {"": {"action": "omit"}}, {"A": "omit"}, {"A": {"action": "run"}}, {"A": {"action": "omit", "x": 1}}, {"A": {"action": "element", "name": "Script"}}, {"A": {"action": "element", "name": "script"}}, {"A": {"action": "element"}}])
def test_mappings(components):
    assert render("x", components) == {"status": "continue", "code": "mdx-invalid-component-mapping"}


def test_others_are_declined_and_codes_reach_the_chain():
    assert plugins.MdxRenderer().render({"kind": "markdown", "body": "x"}) == {"status": "decline"}
    assert plugins.MdxRenderer().render({"kind": "mdx"}) == {"status": "decline"}
    got = plugins.render_chain({"kind": "mdx", "body": "{"}, [plugins.MdxRenderer()])
    assert got["status"] == "decline" and got["codes"] == "mdx-parse-failed"
    assert render("<Other>x</Other>", unknown="unwrap")["markdown"] == "x"
    assert plugins.MdxRenderer(omit=["A"], elements={"B": "b"}).render({"kind": "mdx", "body": "<A>x</A><B>y</B>"})["markdown"] == "<b>y</b>"


def test_long_sources_are_read_in_one_pass():
    source = "<Box>x {/* c */}</Box>\n" * 20_000
    assert render(source)["markdown"] == "x \n" * 20_000
    assert len(mdx.parse("<Box>" * 3000 + "</Box>" * 3000)) == 1


def test_synthetic_origin():
    class Links:
        name, api_version = "links", 1

        def render(self, page):
            return {"status": "rendered", "markdown": f"[a]({page['url']}) [b](https://real.com/x)"}

    wrapped = plugins.SyntheticOrigin(Links())
    assert wrapped.render({"pathname": "/p/q"})["markdown"] == "[a](/p/q) [b](https://real.com/x)"
    assert "real" in wrapped.render({"url": "https://e.com/z"})["markdown"] and wrapped.name == "links"
