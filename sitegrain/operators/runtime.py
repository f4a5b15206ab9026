"""Decisions of a request, as joins on a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import accept, paths, text
from .corpus import dispatch
from .records import first_wins


def page_set(static: DataFrame, descriptors: DataFrame, owned: DataFrame) -> DataFrame:
    """(site, pathname, title): static paths and descriptors, the last descriptor winning,
    without the paths that artifacts own, at their ``site`` or, without one, everywhere."""
    last = first_wins(descriptors, ["site", "pathname"], "row_ord", last=True)
    both = static.select("site", "pathname").distinct().join(last.select("site", "pathname", "title"), ["site", "pathname"], "full_outer")
    return both.join(owned, [c for c in ("site", "pathname") if c in owned.columns], "left_anti").select("site", "pathname", "title")


def respond(requests: DataFrame, artifacts: DataFrame, mode: str = "inline") -> DataFrame:
    """Status and representation of (request_id, site, path, method, accept, if_none_match).

    ``artifacts`` has (site, served_path, body).  A page is negotiated: its Markdown
    copy is served inline, or by a redirect (303), if that is preferred.  A matching
    entity tag gives 304; HEAD and bodyless statuses have no body.
    """
    kind = dispatch(F.col("path"))
    wants = accept.prefers_markdown_column(F.col("accept"))
    asked = requests.select(
        "*", kind.alias("kind"), F.when(kind.isNull() & F.lit(mode != "off") & wants, paths.md_pathname(F.col("path"))).otherwise(F.col("path")).alias("served_path")
    )
    found = asked.join(artifacts, ["site", "served_path"], "left")
    negotiated = F.col("served_path") != F.col("path")
    tag = text.etag(F.col("body"))
    status = (
        F.when(F.col("body").isNull(), 404)
        .when(negotiated & F.lit(mode == "redirect"), 303)
        .when(accept.not_modified(F.col("if_none_match"), tag), 304)
        .otherwise(200)
    )
    out = found.select("request_id", "site", "path", "served_path", "method", "body", status.alias("status"), tag.alias("etag"), text.content_type(F.col("served_path")).alias("content_type"))
    no_body = accept.bodyless(F.col("status"), F.col("method")) | (F.col("status") == 303)
    return out.withColumn("body", F.when(~no_body, F.col("body"))).withColumn("vary", F.lit("Accept")).drop("method")


def represent(responses: DataFrame) -> DataFrame:
    """What goes out where a representation was generated for an upstream response.

    Rows have request_id, method, if_none_match, status, headers (map), body, and
    ``generated`` with ``generated_type``, null where nothing was.  A representation
    made from a page that is no UTF-8 HTML, or is compressed, is not used: the upstream
    response goes on as it is (``replaced`` false).  Otherwise headers that describe the
    old body go, a partial response becomes a whole one, and an entity that the client
    has gives 304, of successful statuses only.
    """
    usable = F.col("generated").isNotNull() & accept.utf8_html(F.col("headers")) & accept.identity_encoded(F.col("headers"))
    rows = responses.withColumn("replaced", usable).withColumn("etag", F.when(usable, text.etag(F.col("generated"))))
    whole = accept.generated_status(F.col("status"))
    known = whole.between(200, 299) & F.coalesce(accept.not_modified(F.col("if_none_match"), F.col("etag")), F.lit(False))
    status = F.when(~F.col("replaced"), F.col("status")).when(known, 304).otherwise(whole)
    new = F.when(known, F.create_map(F.lit("etag"), "etag")).otherwise(F.create_map(F.lit("etag"), F.col("etag"), F.lit("content-type"), F.col("generated_type")))
    kept = F.map_filter(accept.strip_body_headers(F.col("headers")), lambda k, _: ~F.lower(k).isin("etag", "content-type"))
    rows = rows.withColumns({"final": status, "out": F.when(F.col("replaced"), F.map_concat(kept, new)).otherwise(F.col("headers"))})
    silent = F.col("replaced") & accept.bodyless(F.col("final"), F.col("method"))
    body = F.when(silent, F.lit(None).cast("string")).when(F.col("replaced"), F.col("generated")).otherwise(F.col("body"))
    return rows.select("request_id", "replaced", F.col("final").alias("status"), F.col("out").alias("headers"), body.alias("body"))


def project_owned(requests: DataFrame, routes: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """Add ``owned``: the project itself has the path, exactly or by a pattern."""
    exact = routes.select("site", F.col("pathname").alias("path"), F.lit(True).alias("exact")).distinct()
    hit = F.coalesce(F.col("exact"), F.lit(False))
    if patterns:
        hit = hit | F.col("path").rlike("|".join(f"(?:{p})" for p in patterns))
    return requests.join(exact, ["site", "path"], "left").withColumn("owned", hit).drop("exact")


def pair_gate(paths_: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """(site, blocked): sites in which either path of a pair is owned block both."""
    return paths_.filter(F.col("path").isin(*pair)).groupBy("site").agg(F.max("owned").alias("blocked"))


def effective_site(configured: Column, origin: Column) -> Column:
    return text.filled(configured, origin)


def sitemaps(sites: DataFrame, files: DataFrame, source: str, alias: str) -> DataFrame:
    """Per site: is the advertised map there, may the alias be written, what do robots say.

    An alias never overwrites a file, and needs its source.
    """
    here = files.filter(F.col("href").isin(source, alias)).groupBy("site").agg(F.max(F.col("href") == source).alias("has_source"), F.max(F.col("href") == alias).alias("has_alias"))
    no = F.lit(False)
    out = sites.select("site").distinct().join(here, "site", "left").select("site", F.coalesce("has_source", no).alias("has_source"), F.coalesce("has_alias", no).alias("has_alias"))
    return out.withColumn("write_alias", F.col("has_source") & ~F.col("has_alias")).withColumn("advertise", F.col("has_source") | F.col("has_alias"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Findings as they may be published: known levels, codes and paths alone."""
    known = F.col("severity").isin("error", "warning", "info") & F.col("code").rlike(r"\A[a-z0-9.\-]+\z")
    cols = [c for c in ("site", "producer", "code", "severity", "pathname", "pointer", "entity_id") if c in findings.columns]
    return findings.filter(known).select(*cols)
