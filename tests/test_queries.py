"""Every registered query runs, and agrees with its SQL where it has one."""

from __future__ import annotations

import os

import pytest

from sitegrain.plans import registry
from tests.compare import differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert differences(spark, FOLDER, registry.QUERIES[name], registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["llms_index", "artifact_conflicts", "catalog_merge", "graph_merge", "extract_markdown"])
def test_same_for_any_number_of_partitions(spark, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(str, registry.QUERIES[name](spark, FOLDER).collect()))

    try:
        assert rows(1) == rows(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
