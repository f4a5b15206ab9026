"""Full corpora in pieces join to the text that a site gets in one."""

from __future__ import annotations

import pytest

from sitegrain.config import Corpus, Site
from sitegrain.operators import corpus
from sitegrain.sources import sinks

SCHEMA = "site string, pathname string, page_ord long, title string, url string, description string, opt_out_tokens array<string>, markdown string"


def _pages(spark, n=3000):
    rows = [(f"s{0 if k % 3 else k % 5}", f"/{k}", k * 7, f"T{k}", f"https://h/{k}", "d" if k % 2 else None, ["no-llms-full"] if k % 13 == 0 else [], None if k % 17 == 0 else "é word\n" * (k % 40)) for k in range(n)]
    rows.append(("lone", "/", None, "Lone", "https://h/", "", ["no-llms"], "gone"))
    rows.append(("long", "/", None, "Long", "https://h/", "", None, "x" * 300_000))
    return spark.createDataFrame(rows, SCHEMA)


def _joined(parts):
    out: dict[str, str] = {}
    for r in sorted(parts.collect(), key=lambda r: (r.site, r.part, r.piece)):
        out[r.site] = out.get(r.site, "") + r.body
    return out


@pytest.mark.parametrize(("size", "pages", "mode"), [(1, 1, "all"), (2000, 100, "all"), (1 << 30, 1 << 30, "all"), (500, 64, "index"), (500, 64, "first-page-only")])
def test_pieces_join_to_the_full_corpus(spark, size, pages, mode):
    df, site = _pages(spark), Site(description="About", corpus=Corpus(full_mode=mode))
    whole = {r.site: r.body for r in corpus.full_corpus(df, site, "note").collect()}
    parts = corpus.full_parts(df, site, "note", part_bytes=size, part_pages=pages)
    assert _joined(parts) == whole
    for r in parts.filter("part >= 0").collect():
        assert r.n_pages < pages + 1024
        last = r.body.rfind("\n# ")
        assert last < size or r.n_pages == 1


def test_refused_sites_and_empty_tables_have_no_pieces(spark):
    df = _pages(spark)
    limited = Site(corpus=Corpus(max_pages=500))
    assert set(_joined(corpus.full_parts(df, limited))) == {r.site for r in corpus.full_corpus(df, limited).collect()} == {"s3", "s1", "s4", "s2", "lone", "long"} - {r.site for r in corpus.refused(df, 500).collect()}
    assert corpus.full_parts(df.limit(0), Site()).count() == 0
    with pytest.raises(ValueError, match="1 or more"):
        corpus.full_parts(df, Site(), part_bytes=0)


def test_content_is_made_of_selected_pages_alone(spark):
    seen = corpus.full_parts(_pages(spark, 50).drop("markdown"), Site(), content=lambda rows: rows.withColumn("markdown", rows.pathname), part_pages=8)
    assert "\n/1\n" in _joined(seen)["s0"] and "\n/13\n" not in _joined(seen)["s0"]


def test_texts_move_once(spark):
    plan = corpus.full_parts(_pages(spark, 50).repartition(3), Site())._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        physical = corpus.full_parts(_pages(spark, 50), Site())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not any("hashpartitioning" in line and "piece" in line for line in physical.splitlines())


def test_part_files_sort_as_the_text_and_are_written(spark, tmp_path):
    df = _pages(spark, 400)
    whole = {r.site: r.body for r in corpus.full_corpus(df, Site()).collect()}
    sinks.write_artifacts(corpus.part_files(corpus.full_parts(df, Site(), part_bytes=1000, part_pages=50)), str(tmp_path / "out"))
    out: dict[str, str] = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.served_path):
        out[r.site] = out.get(r.site, "") + r.body
    assert out == whole
