"""Artifacts of plugins: declared claims, generated and validated contents, answers to requests.

A plugin declares claims on exact paths.  Hooks are functions of tables: the stages
``artifact:generate`` and ``artifact:validate`` get the claims of all plugins as rows
and the pages' names, and give the rows back with contents.  Each hook's result is
carried out before the next hook runs, so one that fails, however late, is left out
and its input goes on.  What comes out are claims for the ownership plan, and findings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import sinks

GENERATE, VALIDATE = "artifact:generate", "artifact:validate"
_CLAIM = "plugin string, plugin_claim string, served_key string, replace boolean, grp string, place int"
_ROW = ["site", "plugin", "plugin_claim", "served_key", "replace", "grp", "place"]
_MEDIA = r"\A[!#$%&'*+.^_`|~0-9A-Za-z-]+/[!#$%&'*+.^_`|~0-9A-Za-z-]+(\s*;[^\r\n]*)?\z"

#: A hook: (claims, pages) -> claims, or null to keep them as they are.
Hook = Callable[[DataFrame, DataFrame], DataFrame | None]


class ClaimError(ValueError):
    """A plugin or a claim that may not be registered."""


@dataclass(frozen=True)
class Claim:
    """A path that a plugin writes; ``replace`` allows that over what others own."""

    id: str
    pathname: str
    replace: bool = False
    group: str | None = None


@dataclass(frozen=True)
class ArtifactPlugin:
    """Claims, and hooks by stage."""

    name: str
    claims: tuple[Claim, ...] = ()
    hooks: dict[str, Hook] = field(default_factory=dict)
    api_version: int = 1


@dataclass(frozen=True)
class Produced:
    """Claims for :func:`sitegrain.operators.ownership.conflicts`, and findings."""

    claims: DataFrame
    findings: DataFrame


def check_plugins(plugins: Sequence[ArtifactPlugin]) -> None:
    """Names and claim ids are there and stand once, paths are exact; else ``ClaimError``."""
    seen: set[str] = set()
    for plugin in plugins:
        if not isinstance(plugin.name, str) or not re.fullmatch(r"[a-z0-9][a-z0-9._@/-]*", plugin.name):
            raise ClaimError(f"no name for a plugin: {plugin.name!r}")
        if plugin.name in seen:
            raise ClaimError(f"two plugins are called {plugin.name}")
        seen.add(plugin.name)
        if plugin.api_version != 1:
            raise ClaimError(f"{plugin.name} has no version 1 interface")
        if unknown := set(plugin.hooks) - {GENERATE, VALIDATE}:
            raise ClaimError(f"{plugin.name} has unknown stages {sorted(unknown)}")
        ids: set[str] = set()
        for claim in plugin.claims:
            if not isinstance(claim.id, str) or not claim.id.strip() or claim.id in ids:
                raise ClaimError(f"{plugin.name} needs an id of its own for each claim")
            ids.add(claim.id)
            if not isinstance(claim.replace, bool):
                raise ClaimError(f"{plugin.name} {claim.id}: replace is true or false")
            path = claim.pathname
            if not isinstance(path, str) or paths.catalog_path(path) != path or path == "/" or re.search(r"[*?#\s]", path):
                raise ClaimError(f"{plugin.name} {claim.id} must claim one exact path")


def _rows(plugins: Sequence[ArtifactPlugin], sites: DataFrame) -> DataFrame:
    """The claims of all plugins for each site; the list is the code's, not the data's."""
    listed = [(p.name, c.id, c.pathname, c.replace, c.group) for p in plugins for c in p.claims]
    one = lambda k, row: F.struct(*[F.lit(v).cast(t).alias(n) for (n, t), v in zip([x.split() for x in _CLAIM.split(", ")], (*row, k), strict=True)])
    every = F.array(*[one(k, row) for k, row in enumerate(listed)]) if listed else F.array().cast(f"array<struct<{_CLAIM.replace(' ', ':').replace(',:', ',')}>>")
    return sites.select("site").distinct().select("site", F.explode(every).alias("c")).select("site", "c.*")


def _stage(rows: DataFrame, pages: DataFrame, plugins: Sequence[ArtifactPlugin], stage: str, found: list[tuple[str, str, str]]) -> DataFrame:
    spark = rows.sparkSession
    for plugin in plugins:
        hook = plugin.hooks.get(stage)
        if hook is None:
            continue
        try:
            out = hook(rows, pages)
            if out is None:
                continue
            have = dict(out.dtypes) if isinstance(out, DataFrame) else {}
            if any(have.get(c) != t for c, t in rows.dtypes):
                found.append((plugin.name, stage, "plugin-invalid-result"))
                continue
            place = sinks.work_folder(spark, "hook")
            out.select(*rows.columns).write.parquet(place)
            done = spark.read.parquet(place)
            # A hook fills in contents; it neither adds claims nor alters them.
            if done.select(*_ROW).exceptAll(rows.select(*_ROW)).limit(1).count():
                found.append((plugin.name, stage, "plugin-invalid-result"))
                continue
            rows = done
        except Exception:  # whatever it is, the others have their turn
            found.append((plugin.name, stage, "plugin-failed"))
    return rows


def produce(plugins: Sequence[ArtifactPlugin], pages: DataFrame) -> Produced:
    """Run the hooks over all claims of all sites of ``pages`` (site, pathname and more).

    Hooks see site, id and pathname of the pages, nothing else.  A claim without a body
    or with a content type that is none is an error and left out.
    """
    check_plugins(plugins)
    spark = pages.sparkSession
    safe = safe_pages(pages).select("site", "id", "pathname")
    rows = _rows(plugins, pages)
    every = rows
    rows = rows.withColumns({"body": F.lit(None).cast("string"), "content_type": F.lit(None).cast("string")})
    found: list[tuple[str, str, str]] = []
    whole = F.col("body").isNotNull() & F.coalesce(F.col("content_type").rlike(_MEDIA), F.lit(False))
    for stage in (GENERATE, VALIDATE):
        rows = _stage(rows, safe, plugins, stage, found).where(whole)
    kept = rows.withColumns({"claim_id": F.col("place"), "owner_name": F.col("plugin"), "dest": F.col("served_key")})
    lost = every.join(rows.select("site", "place"), ["site", "place"], "left_anti")
    missing = lost.select("site", F.lit("plugin").alias("producer"), F.lit("plugin-artifact-missing").alias("code"), F.lit("error").alias("severity"), F.col("served_key").alias("pathname"), "plugin")
    failed = spark.createDataFrame([(p, c) for p, _, c in found], "plugin string, code string")
    failed = failed.select(F.lit(None).cast("string").alias("site"), F.lit("plugin").alias("producer"), "code", F.lit("error").alias("severity"), F.lit(None).cast("string").alias("pathname"), "plugin")
    claims = kept.select("site", "claim_id", "owner_name", "plugin_claim", "served_key", "dest", "grp", "replace", "body", "content_type")
    return Produced(claims, missing.unionByName(failed))


# -- requests ------------------------------------------------------------------

_SAFE = ("route_pattern", "rendering", "canonical_url", "markdown_url", "language", "metadata", "markdown", "plain_text", "dates", "authors", "entities", "directives", "extraction")


def safe_pages(pages: DataFrame) -> DataFrame:
    """What a plugin may see of pages: no request, header, cookie, html or path on disk.

    Pages with an unsafe path are left out; of one path the first by id stays.
    """
    own = F.coalesce(F.col("id"), F.col("pathname")) if "id" in pages.columns else F.col("pathname")
    kept = [c for c in _SAFE if c in pages.columns]
    rows = pages.where(paths.catalog_path_column(F.col("pathname")) == F.col("pathname")).select("site", own.alias("id"), "pathname", *kept)
    if "rendering" in kept:
        rows = rows.withColumn("rendering", F.when(F.col("rendering").isin("prerendered", "on-demand"), F.col("rendering")))
    first = rows.groupBy("site", "pathname").agg(F.min_by(F.struct("id", *kept), "id").alias("p"))
    return first.select("site", "p.id", "pathname", *[F.col("p")[c].alias(c) for c in kept])


def answer(requests: DataFrame, produced: DataFrame, core: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests (request_id, site, path, method) with what plugins answer: ``status`` and ``body``.

    Null status: not a plugin's business, as for other methods, paths that nobody
    claims, and routes of the project unless the claim replaces.  Two claims on a path,
    or one that the core claims too, are an error, 500.
    """
    on_path = produced.groupBy("site", F.col("served_key").alias("path")).agg(
        F.count("*").alias("n"), F.min_by("body", "claim_id").alias("body"), F.min_by("content_type", "claim_id").alias("content_type"), F.min_by("replace", "claim_id").alias("replace"), F.min_by("owner_name", "claim_id").alias("plugin")
    )
    mine = core.select("site", "path", F.lit(True).alias("core")).distinct()
    project = routes.select("site", F.col("pathname").alias("path"), F.lit(True).alias("routed")).distinct()
    all_ = requests.join(on_path, ["site", "path"], "left").join(mine, ["site", "path"], "left").join(project, ["site", "path"], "left")
    no = F.lit(False)
    asked = F.upper("method").isin("GET", "HEAD") & F.col("n").isNotNull()
    clash = (F.col("n") > 1) | F.coalesce("core", no)
    passes = F.coalesce("routed", no) & ~F.coalesce("replace", no)
    status = F.when(asked & clash, 500).when(asked & ~passes, 200)
    shown = (status == 200) & (F.upper("method") == "GET")
    return all_.select("request_id", "site", "path", status.alias("status"), F.when(status == 200, F.col("plugin")).alias("plugin"), F.when(status == 200, F.col("content_type")).alias("content_type"), F.when(shown, F.col("body")).alias("body"))
