"""Main-text extraction: held-out pages, hand-made ones, and odd rows."""

from __future__ import annotations

import itertools
import random

import pytest

from sitegrain.llm import extraction, pagemaker


@pytest.fixture(scope="module")
def model():
    return extraction.default_model()


def test_held_out_pages(model):
    right = wrong = missed = 0
    for page, text in pagemaker.pages(300, seed=99):
        found, labels = extraction.labelled_blocks(page, text)
        for block, label, kept in zip(found, labels, extraction.decode(model, found), strict=True):
            n = len(block.text.split())
            right, wrong, missed = right + n * (label and kept), wrong + n * (kept and not label), missed + n * (label and not kept)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_blocks_hold_the_labelled_texts():
    for page, text in pagemaker.pages(200, seed=5):
        found, labels = extraction.labelled_blocks(page, text)
        assert "\n\n".join(b.text for b, label in zip(found, labels, strict=True) if label) == text


PROSE = ["The harbour was rebuilt after the storm, and most of the boats returned within a year.", "Prices rose. Few were surprised.", "Town council met on Monday to discuss the budget; nobody objected."]
ARTICLE = "<h1>Harbour &amp; town</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
TEXT = "\n\n".join(["Harbour & town", *PROSE])
AROUND = [
    "<header><a href='/'>The Daily</a><p>News since 1900 from the whole coast.</p></header>",
    "<nav><a href=/a>Home</a> <a href=/b>World</a></nav>",
    "<div class='cookie-notice'><p>We use cookies on this site, and by reading on you agree.</p><button>Accept</button></div>",
    "<aside><h3>Related</h3><p>Another story about boats that you may want to read today.</p></aside>",
    "<div id='sidebar'><ul><li><a href=/x>Popular one</a></li><li><a href=/y>Popular two</a></li></ul></div>",
    "<div class=ad>Buy these new boots now, they are the best of all.</div>",
    "<form action=/s><label>Your email <input name=e></label><button>Subscribe</button></form>",
    "<script>document.write('<p>never</p>')</script><style>p { x: y }</style><!-- <p>nor this</p> -->",
]
BELOW = ["<section id=comments><h3>2 comments</h3><div class=comment><b>Ann</b><p>I remember that storm very well, it took our roof.</p></div></section>", "<footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer>"]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article class=post>{}</article></main>", "<div class='post-content'>{}</div>", "<main>{}</main>"])
def test_hand_made_pages(model, wrap):
    rng = random.Random(2)
    for _ in range(25):
        above, below = rng.sample(AROUND, 3), rng.sample(BELOW, rng.randint(0, 2))
        page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(above) + wrap.format(ARTICLE) + "".join(below) + "</body></html>"
        assert extraction.main_text(model, page) == TEXT, page


def test_reading_of_markup():
    def texts(page):
        return [b.text for b in extraction.blocks(page)]

    assert texts("<p><b>One<br><p>two &lt;b&gt; &eacute;&#233;&nbsp;x") == ["One", "two <b> éé x"]
    assert texts("<P>a<SPAN>b</SPAN>c</P>d<div>e\n\t f</div>") == ["abc", "d", "e f"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("1 < 2 and <3 <p>x</p></div></p>y<a href='x>z") == ["1 < 2 and <3", "x", "yz"]
    assert texts("<p>a<!-- b <p>c") == ["a"] and texts("<script>x") == [] and texts("<p>t<textarea>u</textarea>v") == ["t v"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>") == ["a", "b", "c"]
    assert texts("x<p") == ["x"] and texts("<title>t</title>") == [] and texts("<!DOCTYPE html>") == []


def test_viterbi_is_the_best_of_all_labels(model):
    for page, _ in pagemaker.pages(30, seed=7):
        found = extraction.blocks(page)[:9]

        def worth(labels, found=found):
            out = model.begins[labels[0]] if labels else 0
            for k, (b, y) in enumerate(zip(found, labels, strict=True)):
                out += y * sum(model.weights.get(f, 0) for f in b.features)
                out += model.moves[b.same][labels[k - 1]][y] if k else 0
            return out

        best = max(worth(y) for y in itertools.product((0, 1), repeat=len(found)))
        assert worth([int(x) for x in extraction.decode(model, found)]) == pytest.approx(best)


def test_training_from_a_table_of_pages():
    own = [(f"<div><p>menu {k}</p></div><blockquote><p>words of it {k}.</p></blockquote>", f"words of it {k}.") for k in range(40)]
    model = extraction.train(own)
    assert extraction.main_text(model, "<div><p>menu x</p></div><blockquote><p>other ones</p></blockquote>") == "other ones"
    with pytest.raises(ValueError):
        extraction.train(own, limit=39)
    with pytest.raises(ValueError):
        extraction.labelled_blocks("<p>a</p>", "b")


def test_odd_rows(spark, model):
    long = "<article>" + "<p>Sentence of the page, again and again.</p>" * 60_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>a</a></nav>"), (4, "u", long), (5, "u", f"<article>{ARTICLE}</article>"), (5, "u", f"<article>{ARTICLE}</article>")]
    df = spark.createDataFrame([(*r, "c", 9) for r in rows], "page_id long, url string, html string, text string, _page int")
    out = extraction.extract(df, model=model)
    assert out.columns == ["page_id", "url", "html", "_page", "text", "n_chars"]
    got = sorted((r.page_id, r.text, r.n_chars) for r in extraction.digest(df).collect())
    assert [g[1] for g in got if g[0] != 4] == ["", "", "", TEXT, TEXT]
    assert all(n == len(t) for _, t, n in got) and [t.count("\n\n") for i, t, _ in got if i == 4] == [59_999]
    assert extraction.digest(df.limit(0)).count() == 0


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extraction.digest(pages).join(pages.select("page_id", "html"), "page_id").collect():
        assert r.text and r.text == extraction.main_text(model, r.html)
        assert "track(" not in r.text and "©" not in r.text
