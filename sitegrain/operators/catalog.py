"""Catalogs merged with concrete pages, and breadcrumbs from catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .records import first_wins


def merge(concrete: DataFrame, catalog: DataFrame) -> DataFrame:
    """Full outer merge by (site, pathname): a descriptor's value wins where it has one.

    Concrete rows have ``page_ord``, descriptors ``row_ord``; of concrete rows of
    one path the first counts, of descriptors the last.  Order: concrete rows, then
    what only the catalog has.
    """
    keys = ["site", "pathname"]
    one = first_wins(concrete, keys, "page_ord")
    two = first_wins(catalog, keys, "row_ord", last=True)
    fields = [c for c in dict.fromkeys([*one.columns, *two.columns]) if c not in (*keys, "page_ord", "row_ord")]
    a, b = one.alias("a"), two.alias("b")
    joined = a.join(b, (F.col("a.site") == F.col("b.site")) & (F.col("a.pathname") == F.col("b.pathname")), "full_outer")

    def pick(c: str):
        sides = [F.col(f"{s}.{c}") for s, df in (("b", two), ("a", one)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return joined.select(
        F.coalesce("a.site", "b.site").alias("site"),
        F.coalesce("a.pathname", "b.pathname").alias("pathname"),
        *(pick(c) for c in fields),
        F.struct(F.col("a.page_ord").isNull().alias("late"), F.coalesce("a.page_ord", "b.row_ord").cast("long").alias("ord")).alias("page_order"),
    )


def without_owned(descriptors: DataFrame, owned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(descriptors left, findings): rows at an artifact's path are dropped and reported.

    ``owned`` has ``pathname``, and ``site`` where a path is owned at one site alone.
    """
    keys = [c for c in ("site", "pathname") if c in owned.columns]
    left = descriptors.join(owned, keys, "left_anti")
    gone = descriptors.join(owned, keys, "left_semi")
    return left, gone.select("site", F.lit("catalog").alias("producer"), F.lit("catalog-path-owned").alias("code"), F.lit("warning").alias("severity"), "pathname")


def breadcrumbs(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(site, pathname, trail): named ancestors from the root to the page, all or none.

    ``trail`` is an array of (position, name, pathname).  A page whose chain has a
    gap, and the root itself, have none.  Ancestors meet their names in one join.
    """
    names = first_wins(catalog.filter(F.trim(F.coalesce("title", F.lit(""))) != ""), ["site", "pathname"], "row_ord").select(
        "site", F.col("pathname").alias("step"), F.trim("title").alias("name")
    )
    steps = pages.filter("pathname != '/'").select("site", "pathname").distinct().select(
        "site", "pathname", F.posexplode(paths.ancestors(F.col("pathname"))).alias("pos", "step")
    )
    return (
        steps.join(names, ["site", "step"], "left")
        .groupBy("site", "pathname")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("name").alias("named"),
            F.sort_array(F.collect_list(F.struct((F.col("pos") + 1).alias("position"), "name", F.col("step").alias("pathname")))).alias("trail"),
        )
        .filter("n = named AND n > 1")
        .select("site", "pathname", "trail")
    )


def breadcrumb_json(trail: Column) -> Column:
    """A trail as a schema.org BreadcrumbList."""
    item = lambda t: F.struct(F.lit("ListItem").alias("@type"), t["position"].alias("position"), t["name"].alias("name"), t["pathname"].alias("item"))
    return F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), F.transform(trail, item).alias("itemListElement")))


def humanized(pages: DataFrame) -> DataFrame:
    """Breadcrumbs by slug, where no catalog names the steps."""
    from ..functions import text

    steps = F.transform(paths.ancestors(F.col("pathname")), lambda p, i: F.struct((i + 1).alias("position"), text.humanize(F.element_at(F.split(p, "/"), -1)).alias("name"), p.alias("pathname")))
    return pages.select("site", "pathname", steps.alias("trail"))
