"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import addresses, artifacts, content, corpora, graphs, publishing, relations, requests

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (publishing, relations, content, graphs, requests, artifacts, corpora, addresses):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
