"""Who may write which artifact: conflicts, groups, stale files, manifest, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand in two rows or more: counted before they meet."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)


def conflicts(claims: DataFrame) -> DataFrame:
    """Claims (site, claim_id, served_key, dest, ...) with ``conflict``.

    All claims on a served key, or on a destination, that two or more share; and
    all whose destination is inside another's or around it.  Ancestry is an equi
    join on the exploded ancestors of each folder, not a comparison of all pairs.
    """
    keyed = repeated(claims, ["site", "served_key"]).withColumn("by_key", F.lit(True))
    placed = repeated(claims, ["site", "dest"]).withColumn("by_dest", F.lit(True))
    dests = claims.select("site", "dest", paths.folder(F.col("dest")).alias("folder"))
    up = dests.select("site", "folder").distinct().withColumn("dest", F.explode(paths.ancestors(F.col("folder"))))
    around = dests.select("site", "dest").join(up.select("site", "dest").distinct(), ["site", "dest"], "left_semi").distinct()
    inside = dests.join(up.join(around, ["site", "dest"], "left_semi").select("site", "folder").distinct(), ["site", "folder"], "left_semi").select("site", "dest")
    nested = around.unionByName(inside).distinct().withColumn("nested", F.lit(True))
    no = F.lit(False)
    return (
        claims.join(keyed, ["site", "served_key"], "left").join(placed, ["site", "dest"], "left").join(nested, ["site", "dest"], "left")
        .withColumn("conflict", F.coalesce("by_key", no) | F.coalesce("by_dest", no) | F.coalesce("nested", no))
        .drop("by_key", "by_dest", "nested")
    )


def externally_owned(claims: DataFrame, routes: DataFrame, files: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Add ``owner``: project-route, public-file, existing-output, or null.

    ``files`` (site, dest, kind, etag) are what is there; an existing output that
    is as the last manifest left it is ours and owned by nobody else.
    """
    exact = routes.select("site", F.col("pathname").alias("served_key"), F.lit(True).alias("routed")).distinct()
    there = files.groupBy("site", "dest").agg(F.max(F.col("kind") == "public").alias("public"), F.max("etag").alias("etag"))
    out = claims.join(exact, ["site", "served_key"], "left").join(there, ["site", "dest"], "left")
    ours = F.lit(False)
    if prior is not None:
        mine = prior.filter("status = 'emitted'").select("site", F.col("pathname").alias("dest"), F.col("etag").alias("prior_etag")).distinct()
        out = out.join(mine, ["site", "dest"], "left")
        ours = F.coalesce(F.col("prior_etag") == F.col("etag"), F.lit(False))
    owner = F.when(F.col("routed"), "project-route").when(F.col("public"), "public-file").when(F.col("public").isNotNull() & ~ours, "existing-output")
    return out.withColumn("owner", owner).drop("routed", "public", "etag", "prior_etag")


def resolve(claims: DataFrame) -> DataFrame:
    """Add ``status``: conflict, preserved, replaced or emit; then group-skipped.

    Of a group every member is emitted or none; the others are skipped.  Needs
    ``conflict``, ``owner``, ``replace`` and ``grp`` (null: no group).
    """
    own = (
        F.when(F.col("conflict"), "conflict")
        .when(F.col("owner").isNotNull() & ~F.coalesce("replace", F.lit(False)), "preserved")
        .when(F.col("owner").isNotNull(), "replaced")
        .otherwise("emit")
    )
    marked = claims.withColumn("status", own)
    whole = marked.filter("grp IS NOT NULL").groupBy("site", "grp").agg(F.bool_and(F.col("status").isin("emit", "replaced")).alias("whole"))
    return marked.join(whole, ["site", "grp"], "left").withColumn(
        "status", F.when(F.col("status").isin("emit", "replaced") & ~F.coalesce("whole", F.lit(True)), "group-skipped").otherwise(F.col("status"))
    ).drop("whole")


def claim_findings(resolved: DataFrame) -> DataFrame:
    codes = {"conflict": "artifact-conflict", "preserved": "artifact-preserved", "replaced": "artifact-replaced", "group-skipped": "artifact-group-skipped"}
    code = F.lit(None).cast("string")
    for status, name in codes.items():
        code = F.when(F.col("status") == status, name).otherwise(code)
    rows = resolved.filter(F.col("status") != "emit")
    return rows.select(
        "site", F.lit("ownership").alias("producer"), code.alias("code"),
        F.when(F.col("status") == "conflict", "error").otherwise("warning").alias("severity"), F.col("dest").alias("pathname"),
    )


def stale(previous: DataFrame, claims: DataFrame, files: DataFrame) -> DataFrame:
    """Outputs of the last run to delete: not claimed now and still as written.

    Of a group all are safe to delete or none is.
    """
    gone = previous.filter("status = 'emitted'").join(claims.select("site", F.col("dest").alias("pathname")).distinct(), ["site", "pathname"], "left_anti")
    same = files.select("site", F.col("dest").alias("pathname"), F.col("etag").alias("now")).distinct()
    checked = gone.join(same, ["site", "pathname"], "left").withColumn("safe", F.coalesce(F.col("now") == F.col("etag"), F.lit(False)))
    groups = checked.filter("grp IS NOT NULL").groupBy("site", "grp").agg(F.bool_and("safe").alias("all_safe"))
    return checked.join(groups, ["site", "grp"], "left").filter(F.col("safe") & F.coalesce("all_safe", F.lit(True))).select("site", "pathname", "grp", "etag")


def report(resolved: DataFrame) -> DataFrame:
    """Artifacts per owner, and in total (owner null)."""
    return resolved.rollup("owner_name").agg(F.count(F.lit(1)).alias("n"))


def claimants(resolved: DataFrame) -> DataFrame:
    """(site, dest, owner_name, n) of what has several claims."""
    return resolved.groupBy("site", "dest", "owner_name").agg(F.count(F.lit(1)).alias("n"))


def claim_of(requests: DataFrame, claims: DataFrame) -> DataFrame:
    """Requests (site, path, ...) with the owner of the claim on their path, or null.

    Of several claims on one path the first by ``claim_id`` answers.
    """
    first = claims.groupBy("site", F.col("served_key").alias("path")).agg(F.min_by("owner_name", "claim_id").alias("owner_name"))
    return requests.join(first, ["site", "path"], "left")


def manifest_entries(resolved: DataFrame, body: Column) -> DataFrame:
    """Entries of the manifest; emitted ones with length and entity tag."""
    done = F.col("status").isin("emit", "replaced")
    return resolved.select(
        "site", F.col("dest").alias("pathname"), F.col("owner_name").alias("owner"),
        F.when(done, "emitted").otherwise(F.col("status")).alias("status"),
        F.when(done, text.etag(body)).alias("etag"), F.when(done, F.octet_length(body)).alias("bytes"), "grp", F.lit(1).alias("version"),
    )
