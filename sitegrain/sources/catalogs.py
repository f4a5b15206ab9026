"""Page catalogs as a Spark data source: one partition per catalog, failures as rows.

A catalog is a function that lists pages.  Spark calls each in a task of its own, so a
slow one holds up no other and one that raises is a row, not a failed job.  With
``where`` a filter on ``catalog`` drops partitions before anything is called; one on
``pathname`` is handed to the functions, which may use it.
"""

from __future__ import annotations

import importlib
import inspect
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import shapes
from . import pages, sinks

SCHEMA = "catalog string, cat_ord int, row_ord int, pathname string, descriptor string, code string, message string"
_FILTERS = "spark.sql.python.filterPushdown.enabled"


class _Catalog(InputPartition):
    def __init__(self, place: int, spec: dict):
        super().__init__(place)
        self.place, self.spec = place, spec


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.specs = json.loads(options.get("catalogs", "[]"))
        self.context = json.loads(options.get("context", "{}"))
        self.push = options.get("push") == "true"
        self.only: set[str] | None = None
        self.pathname: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.push and isinstance(f, (EqualTo, In)) and f.attribute == ("catalog",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
                continue
            if self.push and isinstance(f, EqualTo) and f.attribute == ("pathname",):
                self.pathname = f.value
            yield f  # functions need not heed it

    def partitions(self) -> list[InputPartition]:
        return [_Catalog(k, s) for k, s in enumerate(self.specs) if self.only is None or s.get("name") in self.only]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, place = partition.spec.get("name"), partition.place
        fault = lambda code, message: (name, place, None, None, None, code, message)
        try:
            module, _, member = str(partition.spec.get("loader", "")).partition(":")
            load = getattr(importlib.import_module(module), member or "list_pages", None)
            if not callable(load):
                yield fault("catalog-missing-list-pages", f"{partition.spec.get('loader')} lists no pages")
                return
            more = dict(partition.spec.get("args", {}))
            if "pathname" in inspect.signature(load).parameters and self.pathname is not None:
                more["pathname"] = self.pathname
            for k, page in enumerate(load(self.context, **more)):
                path = page.get("pathname") if isinstance(page, dict) else None
                yield name, place, k, path if isinstance(path, str) else None, json.dumps(page, ensure_ascii=False), None, None
        except Exception as error:
            yield fault("catalog-load-failed", f"{type(error).__name__}: {error}"[:500])


class CatalogSource(DataSource):
    """``spark.read.format("catalogs")`` with options ``catalogs`` (JSON list of name, loader, args) and ``context``."""

    @classmethod
    def name(cls) -> str:
        return "catalogs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listed(spark: SparkSession, catalogs: list[dict], context: dict | None = None, where: str | None = None) -> DataFrame:
    """What the catalogs list, lazily; rows with ``code`` say what failed.

    Each catalog is ``{"name", "loader": "module:function", "args"}``; the function is
    called with the context and args, and yields descriptors.  ``where`` is pushed
    down.  Other filters are not: Spark keeps what was pushed with the relation, so a
    later query of the same DataFrame without the filter would be short of rows.
    """
    spark.conf.set(_FILTERS, "true")
    spark.dataSource.register(CatalogSource)
    options = {"catalogs": json.dumps(catalogs), "context": json.dumps(context or {}), "push": str(where is not None).lower()}
    rows = spark.read.format("catalogs").options(**options).load()
    return rows if where is None else rows.where(where)


def load(spark: SparkSession, site: str, catalogs: list[dict], context: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(descriptors, findings) of all catalogs; a catalog that fails contributes nothing.

    Every catalog is called once: what it lists is written in the shared folder.
    Values of a type that a field cannot have are left out, paths and dates are
    checked as by :func:`sitegrain.sources.pages.catalog`.
    """
    place = sinks.work_folder(spark, "catalogs")
    listed(spark, catalogs, context).write.parquet(place)
    raw = spark.read.parquet(place)
    failed = raw.where("code IS NOT NULL")
    rows = raw.where("code IS NULL").join(failed.select("catalog").distinct(), "catalog", "left_anti")
    value = shapes.parsed(F.col("descriptor"))
    member = lambda key: shapes.text_of(shapes.member(F.col("v"), key))
    dates = shapes.member(F.col("v"), "dates")
    typed = rows.withColumn("v", value).select(
        F.lit(site).alias("site"), "catalog", "cat_ord", "row_ord", F.coalesce("pathname", F.lit("")).alias("pathname"),
        *[member(k).alias(k) for k in ("title", "description", "image", "language", "markdown")],
        shapes.text_of(shapes.member(dates, "published")).alias("published"), shapes.text_of(shapes.member(dates, "modified")).alias("modified"),
    )
    kept, found = pages.catalog(typed)
    broken = failed.select(F.lit(site).alias("site"), F.lit("catalog").alias("producer"), "code", F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("pathname"))
    return kept, broken.unionByName(found)


def json_lines(context: dict, path: str, pathname: str | None = None) -> Iterator[dict]:
    """A catalog kept as files of JSON lines under a folder: a loader for ``catalogs``."""
    from .transactions import at

    system, base = at(path)
    from pyarrow import fs

    for info in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path) as body:
                for line in body.read().decode().splitlines():
                    page = json.loads(line)
                    if pathname is None or page.get("pathname") == pathname:
                        yield page
