"""Staged tables: who deletes them, and when."""

import os
import subprocess
import sys

import pytest

from sitegrain.llm import common

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def held(spark):
    folder = common.shared_dir(spark).removeprefix("file://") + "/sitegrain"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_block_deletes_what_was_staged_in_it(spark):
    before = held(spark)
    with common.staging(spark) as keep_outer:
        with common.staging(spark) as keep:
            common.staged(spark.range(3).toDF("a"), "inner")
            gone = common.staged(spark.range(3).toDF("a"), "gone")
            common.discard(gone)
            kept = keep(common.staged(spark.range(5).toDF("a"), "kept"))
        assert kept.count() == 5
        assert {x.split("-")[0] for x in held(spark) - before} == {"kept"}
        outer = keep_outer(common.staged(kept.filter("a > 1"), "outer"))
    assert outer.count() == 3 and {x.split("-")[0] for x in held(spark) - before} == {"outer"}
    common.discard(outer)
    assert held(spark) == before


def test_a_block_that_fails_deletes_too(spark):
    before = held(spark)
    with pytest.raises(RuntimeError), common.staging(spark):
        common.staged(spark.range(3).toDF("a"), "inner")
        raise RuntimeError
    assert held(spark) == before


def test_the_pipeline_leaves_no_table_behind(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = ["", None, *(f"the words of text {k} are not many but they are enough for a rule or two to like {k}" for k in range(40))]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item that no text has in it at all, of more than five words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = held(spark)
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {x.split("-")[0] for x in held(spark) - before} <= {"source_mix", "tokens"}


def test_what_is_left_goes_with_the_driver(tmp_path):
    code = (
        "from pyspark.sql import SparkSession; from sitegrain.llm import common; import os\n"
        f"spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n"
        "common.staged(spark.range(3).toDF('a'), 'left')\n"
        f"print('held', len(os.listdir('{tmp_path}/sitegrain')))\n"
        "spark.stop()\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert "held 1" in done.stdout, done.stderr[-2000:]
    assert not os.listdir(tmp_path / "sitegrain")
