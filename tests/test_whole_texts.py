"""Registered queries read whole texts, past the prefixes they were once cut to."""

from __future__ import annotations

import pyarrow as pa
import pytest

from sitegrain.config import Site
from sitegrain.functions.html import markdown
from sitegrain.operators import heads, records
from sitegrain.plans import registry

HTML = "<html><head><title>{0}</title></head><body><main><h1>{0}</h1>{1}</main></body></html>"
HTML_TITLES = {"/b": "T0", "/": "T1"}


@pytest.mark.parametrize(("name", "held"), [("llms_full_all", ("/", "/b")), ("llms_full_index", ("/",)), ("llms_full_first_page", ("/b",))])
def test_full_corpus_holds_the_markdown_of_whole_pages(spark, tmp_path, name, held):
    long = {p: "".join(f"<p>{p} word {k} &amp; <em>more</em></p>" for k in range(200)) for p in ("/", "/b")}
    pages = [(k, f"https://a.com{p}", HTML.format(f"T{k}", long[p])) for k, p in enumerate(("/b", "/"))]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    [row] = registry.QUERIES[name](spark, str(tmp_path)).collect()
    for p in long:
        assert (f"{p} word 199 & _more_" in row.body) == (p in held)
    body = "".join(f"\n# {HTML_TITLES[p]}\n\nURL: https://a.com{p if p == '/' else p + '/'}\n\n{_markdown(pages, p)}\n\n---\n" for p in ("/b", "/") if p in held)
    assert row.body == "# T1\n\n---\n" + body


def _markdown(pages, path):
    [(url, html)] = [(u, h) for _, u, h in pages if u == f"https://a.com{path}"]
    return markdown.extract(html, Site().extraction, url)["markdown"]


def test_text_functions_read_past_the_60th_character(spark, tmp_path):
    rows = [(0, "x" * 80 + " & < | \\ \n end", "s"), (1, "y" * 60 + "&amp;", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.QUERIES["text_functions"](spark, str(tmp_path)).collect()}
    assert got[0].xml.startswith("x" * 80 + " &amp; &lt; | \\ \n end &lt;a")
    assert got[0].cell.startswith("x" * 80 + " & < \\| \\\\   end <a")
    assert got[0].quoted.startswith('"' + "x" * 80 + " & < | \\\\ \\n end <a")
    assert got[1].back.startswith("y" * 60 + "&amp; <a")


def test_pages_become_objects_in_pieces_of_bounded_size():
    """A batch of any number of rows is worked on a megabyte at a time, no row lost."""
    texts = ["x" * 1000] * 5000 + [None, "", "é" * (2 << 20), None] + ["y" * 700_000] * 3
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["k", "html"])
    parts = list(records.pieces(batch, 1))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert all(p.num_rows == 1 or sum(len((v or "").encode()) for v in p.column(1).to_pylist()) <= records.PIECE for p in parts)
    assert list(records.pieces(batch.slice(0, 0), 1)) == [] and len(parts) > 8


def test_heads_of_edited_pages_without_the_pages(spark):
    pages = spark.createDataFrame([(1, "<head></head>"), (2, "<head><link rel=alternate type=text/markdown href=/x></head>"), (3, None)], "k int, html string")
    out = records.with_head(pages, edit=lambda v: heads.with_alternate(v, "/self.md", "auto"))
    assert out.columns == ["k", "head"]
    assert {r.k: r.head and [x.href for x in r.head.links] for r in out.collect()} == {1: ["/self.md"], 2: ["/x"], 3: None}
