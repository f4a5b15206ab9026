"""Sinks: artifacts as files, behind a check of their destinations."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def within_root(root: str, path: str) -> str:
    """``path`` under ``root``; ``ValueError`` if it leads out of it."""
    out: list[str] = []
    for part in PurePosixPath(root, path).parts if not path.startswith("/") else PurePosixPath(path).parts:
        out = out[:-1] if part == ".." else [*out, part]
    found = PurePosixPath(*out) if out else PurePosixPath("/")
    base = PurePosixPath(root)
    if found != base and base not in found.parents:
        raise ValueError(f"{path} leads out of {root}")
    return str(found)


def check_destinations(claims: DataFrame) -> DataFrame:
    """Destinations that cannot be written together: twice the same, or one inside another."""
    twice = claims.groupBy("site", "dest").count().filter("count > 1").select("site", "dest", F.lit("duplicate").alias("problem"))
    folders = claims.select("site", paths.folder(F.col("dest")).alias("folder")).distinct()
    up = folders.select("site", F.explode(paths.ancestors(F.col("folder"))).alias("dest")).distinct()
    nested = claims.select("site", "dest").join(up, ["site", "dest"], "left_semi").distinct()
    return twice.unionByName(nested.select("site", "dest", F.lit("nested").alias("problem")))


def write_artifacts(claims: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write (site, served_path, content_type, body) rows, all or nothing.

    Spark's commit protocol publishes the files of a job together; ``mode`` is
    the policy for what is there already (overwrite, ignore, errorifexists).
    """
    problems = check_destinations(claims.select("site", F.col("served_path").alias("dest"))).limit(1).collect()
    if problems:
        raise ValueError(f"destinations collide: {problems[0]}")
    claims.select("site", "served_path", "content_type", "body").write.mode(mode).partitionBy("site").parquet(folder)


def write_text(rows: DataFrame, folder: str, column: str = "body", mode: str = "errorifexists") -> None:
    """One text per site (robots, indexes, maps), in a folder per site."""
    rows.select("site", F.col(column).alias("value")).write.mode(mode).partitionBy("site").text(folder)


def sitemap_plan(mode: str, has_own: bool, has_site: bool) -> str:
    """What to do about a sitemap: register, expect one, warn, or nothing."""
    if mode == "disabled":
        return "none"
    if has_own:
        return "expected"
    if not has_site:
        return "warn" if mode == "always" else "none"
    return "register"


def sitemap_policy(value: bool | None) -> str:
    return "auto" if value is None else "always" if value else "disabled"


def work_folder(spark: SparkSession, stem: str) -> str:
    """A new place in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset, a session in one process gets a temporary folder, which goes
    when the process ends; on a cluster ``ValueError`` is raised.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/{stem}-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="sitegrain-")
    atexit.register(shutil.rmtree, folder, True)
    return "file://" + folder
