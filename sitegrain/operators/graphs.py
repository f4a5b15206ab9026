"""Entity graphs on Spark: relational parts as joins, the fold per page in Python.

A page's fold depends on order, so it runs in one group per page, which is
small.  Across a site roles are dropped, so entities meet by id alone and the
groups are ids; entities without an id are distinct texts.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graph as G
from ..functions import paths

#: (site, pathname, ord, entity, roles, provenance): JSON texts and an array of roles.
ENTRY = "site string, pathname string, ord int, entity string, roles array<string>, provenance string"
MERGED = "site string, pathname string, ord int, id string, types array<string>, entity string, roles array<string>, provenance string"
FINDING = "site string, pathname string, code string, severity string, entity_id string, pointer string"


def _entry(row) -> dict:
    roles = [] if row.roles is None else [r for r in row.roles]
    return {"entity": G.loads(row.entity), "roles": roles, "provenance": json.loads(row.provenance) if row.provenance else [{"source": "api"}]}


def authored_entities(pages: DataFrame) -> DataFrame:
    """(site, pathname, ord, entity, error) of JSON-LD scripts, from (site, pathname, head)."""
    kind = "array<struct<entity:string,error:string>>"

    @F.pandas_udf(kind)
    def read(scripts: pd.Series) -> pd.Series:
        def one(texts):
            out = []
            for t in [] if texts is None else texts:
                good, bad = G.authored(t)
                out += [{"entity": G.stable(e), "error": None} for e in good] + [{"entity": None, "error": c} for c in bad]
            return out

        return scripts.map(one)

    found = pages.select("site", "pathname", F.posexplode(read(F.col("head.scripts"))).alias("ord", "e"))
    return found.select("site", "pathname", "ord", "e.entity", "e.error")


def entry_findings(entries: DataFrame) -> DataFrame:
    """Findings for entries that are no JSON objects; no merge counts them."""
    return entries.filter(~_sound(F.col("entity"))).select("site", F.lit("graph").alias("producer"), F.lit("schema.invalid-graph").alias("code"), F.lit("error").alias("severity"), "pathname")


def _sound(entity: Column) -> Column:
    """Whether a text is a JSON object, told without leaving Spark's own functions."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(entity)).startswith("OBJECT"), F.lit(False))


def merge_pages(entries: DataFrame, policy: str = "error") -> DataFrame:
    """One merged graph per page, in ``ord`` order; entries that are no JSON are left out."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        merger = G.Merger(policy)
        for row in rows.sort_values("ord", kind="stable").itertuples():
            try:
                merger.add(_entry(row))
            except (G.GraphError, ValueError):
                continue
        site, path = rows["site"].iloc[0], rows["pathname"].iloc[0]
        out = [
            (site, path, k, e["entity"].get("@id"), G.types(e["entity"]), G.stable(e["entity"]), e["roles"], G.stable(e["provenance"]))
            for k, e in enumerate(merger.entries)
        ]
        return pd.DataFrame(out, columns=["site", "pathname", "ord", "id", "types", "entity", "roles", "provenance"])

    return entries.select("site", "pathname", "ord", "entity", "roles", "provenance").groupBy("site", "pathname").applyInPandas(fold, MERGED)


def merge_site(entries: DataFrame, policy: str = "error") -> DataFrame:
    """(site, id, types, entity): a site's entities, merged by id without their roles.

    Equal entities are one row before anything moves, so an entity that every page
    repeats is no large group.  Entries that are no entities are left out, as in
    :func:`merge_pages`; :func:`entry_findings` has them.
    """
    parts = F.get_json_object("entity", "$.@id")
    rows = entries.filter(_sound(F.col("entity"))).select("site", "entity", F.coalesce(F.get_json_object(F.col("entity"), "$['@id']"), parts).alias("id")).distinct()
    named, others = rows.filter("id IS NOT NULL"), rows.filter("id IS NULL")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        merger = G.Merger(policy)
        for text in sorted(group["entity"]):
            try:
                merger.add(G.loads(text))
            except G.GraphError:
                continue
        return pd.DataFrame([(group["site"].iloc[0], e["entity"].get("@id"), G.types(e["entity"]), G.stable(e["entity"])) for e in merger.entries], columns=["site", "id", "types", "entity"])

    kind = "site string, id string, types array<string>, entity string"
    listed = F.coalesce(F.from_json(F.get_json_object("entity", "$['@type']"), "array<string>"), F.array(F.get_json_object("entity", "$['@type']")))
    merged = named.groupBy("site", "id").applyInPandas(fold, kind)
    return merged.unionByName(others.select("site", "id", F.array_compact(listed).alias("types"), "entity"))


def validate_pages(entries: DataFrame, pages: DataFrame, strict: bool = True, policy: str = "error") -> DataFrame:
    """Findings of each page's graph; ``pages`` gives (site, pathname, canonical_url)."""

    def check(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        base = right["canonical_url"].iloc[0] if len(right) and isinstance(right["canonical_url"].iloc[0], str) else None
        inputs = []
        for row in left.sort_values("ord", kind="stable").itertuples():
            try:
                inputs.append(_entry(row))
            except (G.GraphError, ValueError):
                inputs.append({"entity": None})
        _, found = G.validate(inputs, base, None, None, strict, policy)
        return pd.DataFrame([(key[0], key[1], f["code"], f["severity"], f["entity_id"], f["pointer"]) for f in found], columns=["site", "pathname", "code", "severity", "entity_id", "pointer"])

    keys = ("site", "pathname")
    return entries.groupBy(*keys).cogroup(pages.select("site", "pathname", "canonical_url").groupBy(*keys)).applyInPandas(check, FINDING)


def duplicate_roles(entries: DataFrame) -> DataFrame:
    """(site, pathname, role, n) of singleton roles that several entities claim."""
    roles = entries.select("site", "pathname", F.explode("roles").alias("role")).filter(F.col("role").isin(*G.SINGLETONS))
    return roles.groupBy("site", "pathname", "role").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unresolved(references: DataFrame, definitions: DataFrame, strict: bool = True) -> DataFrame:
    """References (site, pathname, pointer, target) of the site itself that nothing defines."""
    own = references.filter(paths.host_of(F.col("target")) == F.col("site"))
    left = own.join(definitions.select("site", F.col("id").alias("target")).distinct(), ["site", "target"], "left_anti")
    return left.select("site", F.lit("graph").alias("producer"), F.lit("schema.unresolved-reference").alias("code"), F.lit("error" if strict else "warning").alias("severity"), "pathname", "pointer", "target")


def match_authored(inferred: DataFrame, authored: DataFrame) -> DataFrame:
    """Inferred (site, pathname, type, url, id) with the first authored entity of the same
    page and type whose document is the same by URL or id: ``authored_ord``, or null."""
    from .records import first_wins

    a = authored.select("site", "pathname", "type", F.explode(F.array_distinct(F.array_compact(F.array(paths.document_key(F.col("url")), paths.document_key(F.col("id")))))).alias("key"), F.col("ord").alias("authored_ord"))
    i = inferred.withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(paths.document_key(F.col("url")), paths.document_key(F.col("id")))))))
    hits = i.join(a, ["site", "pathname", "type", "key"]).select("site", "pathname", "type", "authored_ord")
    best = first_wins(hits, ["site", "pathname", "type"], "authored_ord")
    return inferred.join(best, ["site", "pathname", "type"], "left")


def equal_graphs(one: DataFrame, two: DataFrame) -> DataFrame:
    """(site, pathname, equal): pages whose entries are the same multiset."""
    def side(df: DataFrame, name: str) -> DataFrame:
        mark = F.xxhash64("entity", F.array_sort("roles"), "provenance")
        return df.groupBy("site", "pathname").agg(F.array_sort(F.collect_list(mark)).alias(name))

    both = side(one, "a").join(side(two, "b"), ["site", "pathname"], "full_outer")
    return both.select("site", "pathname", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


def diff_graphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(site, pathname, op, id): what changed per page, by identity and text."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("site", "pathname", F.coalesce("id", "entity").alias("id"), F.struct("entity", F.array_sort("roles").alias("roles"), "provenance").alias(name))

    both = side(before, "old").join(side(after, "new"), ["site", "pathname", "id"], "full_outer")
    op = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "update")
    return both.select("site", "pathname", op.alias("op"), "id").filter("op IS NOT NULL")


def patch_pages(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply (site, pathname, patch) operations to each page's entries.

    Returns (site, pathname, ord, entity, conflict): the entries that are left,
    and rows with ``conflict`` for operations whose base has changed.
    """
    kind = "site string, pathname string, ord int, entity string, conflict string"

    def apply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = [_entry(r) for r in left.sort_values("ord", kind="stable").itertuples()]
        operations = [op for text in right["patch"] for op in json.loads(text)]
        kept, bad = G.patch(held, operations)
        out = [(*key, k, G.stable(e["entity"]), None) for k, e in enumerate(kept)] + [(*key, None, None, b) for b in bad]
        frame = pd.DataFrame(out, columns=["site", "pathname", "ord", "entity", "conflict"])
        return frame.astype({"ord": "Int32"})

    keys = ("site", "pathname")
    return base.groupBy(*keys).cogroup(patches.groupBy(*keys)).applyInPandas(apply, kind)
