"""From claims to files to the manifest: what is written, under which policy, all or none.

:func:`arbitrate` is for claims that are carried out one after another, each with a
policy for what is there already.  :func:`publish` decides about all claims first,
then commits changed files, deletes of stale ones and edited pages as one transaction,
and switches the manifest last.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyarrow import fs as _fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import edits as _edits
from ..functions import text
from ..sources import transactions
from . import ownership

OVERWRITE, WARN, SKIP = "overwrite", "warn-overwrite", "skip"
_ENTRIES = "site string, pathname string, owner string, status string, etag string, bytes long, grp string, version int"
_FINDING = "site", "producer", "code", "severity", "pathname"


class PublishError(Exception):
    """Claims that may not be carried out; nothing was written but redactions."""


class Published(NamedTuple):
    """Manifest entries, findings, and the files written or deleted."""

    manifest: DataFrame
    findings: DataFrame
    operations: int


def arbitrate(claims: DataFrame, routes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, findings) of claims carried out in order of ``claim_id``.

    Claims have site, claim_id, dest, served_key, owner_name and ``policy``:
    overwrite, warn-overwrite (the same, with a finding where a file is there) or
    skip (writes only where no file, earlier claim, route or public file is).
    Decisions add ``written`` and ``final``, for the write that stays.  All claims on
    a destination meet in one window; only whether there is an earlier one matters.
    """
    routed = routes.select("site", F.col("pathname").alias("served_key"), F.lit(True).alias("routed")).distinct()
    there = files.groupBy("site", "dest").agg(F.bool_or(F.col("kind") == "public").alias("public"), F.bool_or(F.col("kind") != "public").alias("output"))
    no = F.lit(False)
    rows = claims.join(routed, ["site", "served_key"], "left").join(there, ["site", "dest"], "left")
    rows = rows.withColumns({c: F.coalesce(c, no) for c in ("routed", "public", "output")})
    place = Window.partitionBy("site", "dest").orderBy("claim_id")
    outside = F.col("routed") | F.col("public") | F.col("output")
    skips = F.col("policy") == SKIP
    # Of several claims the first is written unless it skips for what is outside; then all that skip do.
    rows = rows.withColumn("written", ~skips | ((F.row_number().over(place) == 1) & ~outside))
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.last(F.when(F.col("written"), F.col("owner_name")), True).over(before))
    after = place.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("final", F.col("written") & ~F.coalesce(F.bool_or("written").over(after), no))
    exists = F.col("output") | F.col("prior").isNotNull()
    what = lambda lost: F.when(F.col("written"), f"{lost}-overwritten").otherwise(f"{lost}-retained")
    codes = F.array(
        F.when(exists & ((F.col("policy") == WARN) | ~F.col("written")), "artifact-exists"),
        F.when(F.col("prior") != F.col("owner_name"), what("artifact-owner")),
        F.when(F.col("routed"), what("artifact-route")),
        F.when(F.col("public"), what("artifact-public")),
    )
    found = rows.withColumn("code", F.explode(F.array_compact(codes)))
    findings = found.select("site", F.lit("writer").alias("producer"), "code", F.lit("warning").alias("severity"), F.col("dest").alias("pathname"), "claim_id")
    return rows.drop("routed", "public", "output", "prior"), findings


# -- manifest -----------------------------------------------------------------


def root_id(root: str) -> str:
    """What tells output roots apart in a manifest without disclosing the path."""
    return "sha256:" + hashlib.sha256(transactions.at(root)[1].encode()).hexdigest()


def read_manifest(spark: SparkSession, root: str, as_root: str | None = None) -> DataFrame | None:
    """Entries of the last run into this root; null without one, or if it is another root's or of another version."""
    system, base = transactions.at(root)
    if system.get_file_info(f"{base}/.manifest").type != _fs.FileType.File:
        return None
    with system.open_input_stream(f"{base}/.manifest") as body:
        try:
            head = json.loads(body.read())
        except ValueError:
            return None
    if not isinstance(head, dict) or head.get("version") != 1 or head.get("root") != root_id(as_root or root) or not isinstance(head.get("name"), str):
        return None
    return spark.read.schema(_ENTRIES).json(f"{root.rstrip('/')}/.manifest-{head['name']}")


def _switch(root: str, name: str) -> None:
    """Let ``.manifest`` name the new entries; the move is one step."""
    system, base = transactions.at(root)
    old = None
    if system.get_file_info(f"{base}/.manifest").type == _fs.FileType.File:
        with system.open_input_stream(f"{base}/.manifest") as body:
            try:
                old = json.loads(body.read()).get("name")
            except (ValueError, AttributeError):
                old = None
    with system.open_output_stream(f"{base}/.manifest.new") as out:
        out.write(json.dumps({"version": 1, "root": root_id(root), "name": name}).encode())
    system.move(f"{base}/.manifest.new", f"{base}/.manifest")
    if old and system.get_file_info(f"{base}/.manifest-{old}").type == _fs.FileType.Directory:
        system.delete_dir(f"{base}/.manifest-{old}")


def _done():
    return F.col("status").isin("emit", "replaced")


def _entries(decided: DataFrame) -> DataFrame:
    """Entries of the manifest, with entity tag and length of what is emitted."""
    return decided.select(
        "site", F.col("dest").alias("pathname"), F.col("owner_name").alias("owner"), F.when(_done(), "emitted").otherwise(F.col("status")).alias("status"),
        F.when(_done(), F.col("etag")).alias("etag"), F.when(_done(), F.col("bytes")).cast("long").alias("bytes"), "grp", F.lit(1).alias("version"),
    )


# -- publish ------------------------------------------------------------------


def _file(site: str = "site", dest: str = "dest"):
    return F.concat(F.col(site), F.col(dest)).alias("path")


def edited_pages(pages: DataFrame, edits: DataFrame, failed: bool = False) -> DataFrame:
    """Pages (site, dest, body) that edits change, with the new body as ``body``, and ``fault``."""
    lists = _edits.staged(edits, ["site", "dest"], failed)
    both = pages.join(lists, ["site", "dest"]).withColumn("old", F.col("body"))
    return both.withColumn("body", _edits.splice(F.col("old"), F.col("edits"))).where(F.col("body") != F.col("old")).select("site", "dest", "body", "fault")


def publish(
    claims: DataFrame,
    root: str,
    routes: DataFrame | None = None,
    public: DataFrame | None = None,
    pages: DataFrame | None = None,
    edits: DataFrame | None = None,
    partial: bool = False,
    before_apply: Callable[[str], None] | None = None,
) -> Published:
    """Decide about claims and carry them out under ``root``, as ``<site><dest>``.

    Claims have site, claim_id, owner_name, served_key, dest, grp, replace and body.
    ``routes`` (site, pathname) and ``public`` (site, dest) are owned by others;
    ``pages`` (site, dest, body) are built pages that ``edits`` change (see
    :func:`sitegrain.functions.edits.staged`).  Files that are as they should be are
    not written again; files of the last run that nobody claims and nobody changed
    are deleted, unless the claims are ``partial``, an update.  Claims that conflict
    raise :class:`PublishError`.  Whatever raises, the tree is as it was, but for
    redactions, which are carried out all the same.
    """
    spark = claims.sparkSession
    name = uuid.uuid4().hex
    none = spark.createDataFrame([], "site string, pathname string")
    routes = none if routes is None else routes
    prior = read_manifest(spark, root)
    known = spark.createDataFrame([], _ENTRIES) if prior is None else prior
    try:
        asked = claims.select("site", "dest").unionByName(known.where("status = 'emitted'").select("site", F.col("pathname").alias("dest"))).distinct()
        now = transactions.fingerprints(asked.select(_file()), root).withColumnRenamed("etag", "now")
        outputs = asked.withColumn("path", _file()).join(now, "path").select("site", "dest", F.lit("output").alias("kind"), F.col("now").alias("etag"))
        # Files are read once: what was found is asked for again below, several times.
        folder = f"{root.rstrip('/')}/.manifest-{name}"
        outputs.write.parquet(f"{folder}/_outputs")
        outputs = spark.read.schema(outputs.schema).parquet(f"{folder}/_outputs")
        files = outputs if public is None else outputs.unionByName(public.select("site", "dest", F.lit("public").alias("kind"), F.lit(None).cast("string").alias("etag")))
        decided = ownership.resolve(ownership.externally_owned(ownership.conflicts(claims), routes, files, known))
        there = outputs.select("site", "dest", F.col("etag").alias("now"))
        decided = decided.join(there, ["site", "dest"], "left").withColumns({"etag": text.etag(F.col("body")), "bytes": F.octet_length("body")}).drop("body")
        # Decisions are made once, over the tree as it is; bodies join again only to be written.
        decided.write.parquet(f"{folder}/_decisions")
        decided = spark.read.parquet(f"{folder}/_decisions")
        blocking = decided.where("status = 'conflict'").agg(F.count("*").alias("n"), F.min("dest").alias("dest")).first()
        if blocking.n:
            raise PublishError(f"{blocking.n} claims conflict, as at {blocking.dest}")
        entries = _entries(decided)
        if partial:
            entries = entries.unionByName(known.join(claims.select("site", F.col("dest").alias("pathname")).distinct(), ["site", "pathname"], "left_anti").select(entries.columns))
        entries.write.mode("append").json(folder)
        changed = decided.where(_done() & (F.col("now").isNull() | (F.col("now") != F.col("etag")))).select("site", "claim_id")
        operations = claims.join(changed, ["site", "claim_id"], "left_semi").select(F.lit("write").alias("kind"), _file(), "body")
        if not partial:
            gone = ownership.stale(known, claims, outputs)
            operations = operations.unionByName(gone.select(F.lit("delete").alias("kind"), _file(dest="pathname"), F.lit(None).cast("string").alias("body")))
        found = ownership.claim_findings(decided)
        if pages is not None and edits is not None:
            edited = edited_pages(pages, edits)
            operations = operations.unionByName(edited.select(F.lit("write").alias("kind"), _file(), "body"))
            wrong = _edits.staged(edits, ["site", "dest"]).where("fault IS NOT NULL")
            found = found.unionByName(wrong.select("site", F.lit("edits").alias("producer"), F.lit("edit-refused").alias("code"), F.lit("error").alias("severity"), F.col("dest").alias("pathname")))
        findings_place = f"{folder}/_findings"
        found.select(*_FINDING).write.parquet(findings_place)
        count = transactions.commit(operations, root, name, before_apply, then=lambda: _switch(root, name))
    except BaseException as error:
        system, base = transactions.at(root)
        if system.get_file_info(f"{base}/.manifest-{name}").type == _fs.FileType.Directory:
            system.delete_dir(f"{base}/.manifest-{name}")
        if pages is not None and edits is not None:
            left = transactions.replace_each(edited_pages(pages, edits, failed=True).select(_file(), "body"), root)
            if left:
                raise PublishError(f"{left} pages could not be redacted") from error
        raise
    return Published(read_manifest(spark, root), spark.read.parquet(findings_place), count)


def publish_batches(root: str, **options) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch of claims updates the tree; a batch that comes again changes nothing."""

    def one(claims: DataFrame, _: int) -> None:
        latest = Window.partitionBy("site", "dest").orderBy(F.desc("claim_id"))
        publish(claims.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n"), root, partial=True, **options)

    return one
