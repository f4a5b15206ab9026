"""Reconciliation of graph views per page, and checks of references across pages.

What has not changed is told by a fingerprint per page and view and never leaves
Spark's own operators; only pages with an edit are folded, one small group each.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import envelope
from ..functions import graph as G
from ..functions import paths

VIEWS = ("authored", "managed", "whole")
RESULT = "site string, pathname string, kind string, view string, ord int, entity string, roles array<string>, provenance string, code string, managed_changed boolean, whole_changed boolean"
_KEYS = ["site", "pathname"]


def _fingerprints(entries: DataFrame, name: str) -> DataFrame:
    """Per page, a fingerprint of each view that does not depend on the order of its entries."""
    one = F.sha2(F.to_json(F.struct("entity", F.array_sort("roles").alias("roles"), "provenance")), 256)
    of = lambda view: F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(F.col("view") == view, F.col("one")))), ""), 256).alias(f"{name}_{view}")
    return entries.withColumn("one", one).groupBy(*_KEYS).agg(*[of(v) for v in VIEWS])


def changed_views(base: DataFrame, edited: DataFrame) -> DataFrame:
    """(site, pathname, authored, managed, whole): whether each view's text changed, for pages where one has."""
    nothing = F.lit("")
    both = _fingerprints(base, "old").join(_fingerprints(edited, "new"), _KEYS, "full_outer")
    flags = [(F.coalesce(f"old_{v}", nothing) != F.coalesce(f"new_{v}", nothing)).alias(v) for v in VIEWS]
    return both.select(*_KEYS, *flags).where("authored OR managed OR whole")


def _read(rows: pd.DataFrame) -> list[dict]:
    out = []
    for r in rows.sort_values("ord", kind="stable").itertuples():
        out.append(G.entry({"entity": G.loads(r.entity), "roles": [] if r.roles is None else list(r.roles), "provenance": json.loads(r.provenance) if r.provenance else None}))
    return out


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    site, path = rows["site"].iloc[0], rows["pathname"].iloc[0]
    flags, code = (False, False), None
    sides: dict[str, list[dict]] = {}
    try:
        for side in ("old", "new"):
            for view in VIEWS:
                sides[f"{side} {view}"] = _read(rows[(rows["side"] == side) & (rows["view"] == view)])
    except (G.GraphError, ValueError):
        code = "managed-graph-invalid"
    kept = {v: sides.get(f"old {v}", []) for v in VIEWS[1:]}
    if code is None and not G.same(sides["old authored"], sides["new authored"]):
        code = "managed-graph-authored-changed"
    if code is None and bool(rows["no_canonical"].iloc[0]):
        if sides["new managed"] or sides["new whole"]:
            code = "managed-graph-canonical-missing"
        else:
            kept = {v: [] for v in kept}
    elif code is None:
        managed, whole, *told, code = envelope.reconcile(*(sides[k] for k in ("old authored", "old managed", "old whole", "new managed", "new whole")))
        flags, kept = tuple(told), {"managed": managed, "whole": whole}
    out = [(site, path, "entry", v, k, G.stable(e["entity"]), e["roles"], G.stable(e["provenance"]), None, *flags) for v, es in kept.items() for k, e in enumerate(es)]
    if code:
        out.append((site, path, "finding", None, None, None, None, None, code, *flags))
    elif "old managed" in sides:
        out += [(site, path, "patch", op["op"], k, G.stable(op), None, None, op["id"], *flags) for k, op in enumerate(G.diff(sides["old managed"], kept["managed"]))]
    return pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"ord": "Int32"})


def reconcile_pages(base: DataFrame, edited: DataFrame, pages: DataFrame) -> DataFrame:
    """Views of each page after edits, with findings and the patch as rows.

    ``base`` and ``edited`` have site, pathname, view (authored, managed, whole), ord,
    entity, roles, provenance; ``pages`` has site, pathname and canonical_url.  Rows of
    the result are of the ``kind`` entry (view managed or whole), finding (``code``) or
    patch (``view`` the operation, ``code`` the id, ``entity`` the operation as JSON).
    An edit that cannot stand leaves the page as it was, with a finding.
    """
    columns = [*_KEYS, "view", "ord", "entity", "roles", "provenance"]
    changed = changed_views(base, edited).select(*_KEYS)
    no_canonical = pages.where("canonical_url IS NULL").select(*_KEYS, F.lit(True).alias("no_canonical")).distinct()
    changed = changed.join(no_canonical, _KEYS, "left").withColumn("no_canonical", F.coalesce("no_canonical", F.lit(False)))
    both = base.select(*columns, F.lit("old").alias("side")).unionByName(edited.select(*columns, F.lit("new").alias("side")))
    folded = both.join(changed, _KEYS).groupBy(*_KEYS).applyInPandas(_fold, RESULT)
    same = base.where("view <> 'authored'").join(changed, _KEYS, "left_anti")
    no = F.lit(False)
    same = same.select(*_KEYS, F.lit("entry").alias("kind"), "view", F.col("ord").cast("int"), "entity", "roles", "provenance", F.lit(None).cast("string").alias("code"), no.alias("managed_changed"), no.alias("whole_changed"))
    return folded.unionByName(same)


# -- across pages --------------------------------------------------------------


def entity_order(entity: Column) -> list[Column]:
    """Sort keys of a site's entities: id (none last), types, then the text, by locale."""
    name = F.coalesce(F.get_json_object(entity, "$['@id']"), F.lit("￿"))
    types = F.coalesce(F.array_join(F.from_json(F.get_json_object(entity, "$['@type']"), "array<string>"), ","), F.get_json_object(entity, "$['@type']"), F.lit(""))
    return [F.collate(c, "UNICODE") for c in (name, types, entity)]


def links(entries: DataFrame, sites: DataFrame) -> DataFrame:
    """Entities with what they define and refer to inside their own site.

    ``entries`` (site, pathname, ord, entity), ``sites`` (site, site_url); adds ``id``,
    ``defined`` and ``used`` (target, pointer), and ``code`` for what is no entity.
    """
    kind = "id string, defined array<string>, used array<struct<target:string,pointer:string>>, code string"

    @F.pandas_udf(kind)
    def read(texts: pd.Series, urls: pd.Series) -> pd.DataFrame:
        out = []
        for text, url in zip(texts, urls, strict=True):
            try:
                value = G.entity(G.loads(text))
            except G.GraphError:
                out.append((None, [], [], "schema.invalid-graph"))
                continue
            defined, used = G.references(value)
            near = []
            for target, pointer in used:
                full = paths.entity_id(target, None)
                if full is None:
                    near.append({"target": None, "pointer": pointer})
                elif isinstance(url, str) and paths.within_site(full, url):
                    near.append({"target": full, "pointer": pointer})
            out.append((value.get("@id"), sorted(defined), near, None))
        return pd.DataFrame(out, columns=["id", "defined", "used", "code"])

    rows = entries.select("site", "pathname", "ord", "entity").join(sites.select("site", "site_url"), "site")
    return rows.withColumn("r", read("entity", "site_url")).select("site", "pathname", "ord", "entity", "r.*")


def site_findings(entries: DataFrame, sites: DataFrame, strict: bool = True, policy: str = "error") -> DataFrame:
    """Findings (site, code, severity, entity_id, pointer) of all pages' entities together.

    References into the site are looked for among the ids of all its pages by an
    anti-join; entities are merged only where one id has differing texts, id by id.
    No group is a site.
    """
    rows = links(entries, sites)
    known = rows.select("site", F.explode("defined").alias("target")).distinct()
    used = rows.select("site", F.explode("used").alias("u")).select("site", "u.target", "u.pointer").distinct()
    error = "error" if strict else "warning"
    finding = lambda code, severity, who: [F.lit(code).alias("code"), F.lit(severity).alias("severity"), who.cast("string").alias("entity_id"), F.col("pointer")]
    lost = used.where("target IS NOT NULL").join(known, ["site", "target"], "left_anti").select("site", *finding("schema.unresolved-reference", error, F.col("target")))
    invalid = used.where("target IS NULL").select("site", *finding("schema.invalid-reference", "error", F.lit(None)))
    broken = rows.where("code IS NOT NULL").select("site", "code", F.lit("error").alias("severity"), F.lit(None).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("pointer"))

    texts = rows.where("id IS NOT NULL").select("site", "id", "entity").distinct()
    clash = texts.groupBy("site", "id").count().where("count > 1").select("site", "id")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        merger = G.Merger(policy)
        for text in sorted(group["entity"]):
            merger.add(G.loads(text))
        site, out = group["site"].iloc[0], []
        for c in merger.conflicts:
            solved = c["resolution"] != "unresolved"
            out.append((site, "schema.scalar-conflict" + "-resolved" * solved, "warning" if solved else "error", c["entity_id"], c["pointer"]))
        return pd.DataFrame(out, columns=["site", "code", "severity", "entity_id", "pointer"])

    conflicts = texts.join(clash, ["site", "id"]).groupBy("site", "id").applyInPandas(meet, "site string, code string, severity string, entity_id string, pointer string")
    return lost.unionByName(invalid).unionByName(broken).unionByName(conflicts)
