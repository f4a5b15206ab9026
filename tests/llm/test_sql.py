"""Queries of this subpackage against their SQL."""

from __future__ import annotations

import os

import pytest

from sitegrain.llm import queries
from tests.compare import differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert differences(spark, FOLDER, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns and docs.count() > 0
        if name != "source_mix":
            assert docs.count() < kept
        kept = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == kept


def test_pipeline_stages_take_odd_tables(spark):
    import corpus_pipeline

    words = " ".join(f"word{k} and more of it" for k in range(30))
    rows = [(1, words, "a"), (1, words, "a"), (2, None, None), (None, words + " end", "a"), (3, "", "b"), (4, words * 400, "b"), (5, "few words", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS rid", "2 AS node", "3 AS quality", "4 AS matches", "5 AS size", "6 AS copies", "7 AS row", "8 AS `a.b`", "9 AS _bucket"
    )
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
    kept = corpus_pipeline.quality_rules(spark, odd, FOLDER).collect()
    assert sum(r.doc_id == 1 for r in kept) in (0, 2) and not any(r.text is None or r.text == "few words" for r in kept)
    left = corpus_pipeline.near_duplicates(spark, odd, FOLDER).collect()
    assert sum(r.doc_id == 1 for r in left) == 2 and any(r.doc_id is None for r in left) and any(r.doc_id == 2 for r in left)
