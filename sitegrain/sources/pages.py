"""Readers of pages, catalogs, authored files and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text

MANIFEST_SCHEMA = "site string, pathname string, owner string, status string, etag string, grp string, version int"
#: Folders of a build that hold no pages.
SKIPPED_FOLDERS = ("node_modules", "pagefind", "_astro")


def pages(spark: SparkSession, folder: str, table: str = "pages") -> DataFrame:
    """Pages of a table of URLs and HTML: ``site``, ``pathname``, ``page_ord``, ``url``, ``html``."""
    raw = spark.read.parquet(f"{folder}/{table}.parquet")
    site, path = paths.site_and_path(F.col("url"))
    return raw.select(site.alias("site"), path.alias("pathname"), F.col("page_id").alias("page_ord"), "url", "html")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan dealt out to all task slots, if the scan has fewer partitions.

    A file is read by one task for each of its row groups, and what is done to a page
    costs far more than to move it.  A large table has more partitions than there are
    slots and is left as it is, without a shuffle.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(slots) if rows.rdd.getNumPartitions() < slots else rows


def files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """Files of a build by extension: ``href`` (path under the folder), ``body``, ``modified``.

    Hidden folders and files, and folders that hold no pages, are left out.
    """
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{extension}").load(folder)
    )
    root = folder.split("://")[-1].removeprefix("file:").rstrip("/")
    inside = F.substring(F.col("path"), F.locate(root, F.col("path")) + len(root), F.length("path"))
    parts = F.filter(F.split(inside, "/"), lambda s: s != "")
    hidden = F.exists(parts, lambda s: F.startswith(s, F.lit(".")) | s.isin(*SKIPPED_FOLDERS))
    return rows.filter(~hidden).select(
        inside.alias("href"), F.decode("content", "UTF-8").alias("body"), F.col("modificationTime").alias("modified")
    )


def built_pages(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """Pages of a build folder, numbered by path."""
    found = files(spark, folder, ".html")
    return found.select(
        F.lit(site).alias("site"), paths.page_of_file(F.col("href")).alias("pathname"), F.col("href"), F.col("body").alias("html"), "modified"
    )


def catalog(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(descriptors, findings) of catalog rows.

    Rows have ``site``, ``cat_ord``, ``row_ord``, ``pathname`` and any of title,
    description, image, language, markdown, published, modified.  Unsafe paths are
    left out and reported; of one path the first descriptor stays and the others
    are reported; a date that is none is left out and reported.
    """
    checked = rows.withColumn("_path", paths.catalog_path_column(F.col("pathname")))
    bad = checked.filter("_path IS NULL")
    order = Window.partitionBy("site", "_path").orderBy("cat_ord", "row_ord")
    ranked = checked.filter("_path IS NOT NULL").withColumn("_rank", F.row_number().over(order))
    dates = [c for c in ("published", "modified") if c in rows.columns]
    kept = ranked.filter("_rank = 1").withColumn("pathname", F.col("_path"))
    wrong = [kept.filter(F.col(d).isNotNull() & text.iso_timestamp(F.col(d)).isNull()) for d in dates]

    def finding(df: DataFrame, code: str) -> DataFrame:
        return df.select("site", F.lit("catalog").alias("producer"), F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.col("pathname"))

    found = finding(bad, "catalog-invalid-pathname").unionByName(finding(ranked.filter("_rank > 1"), "catalog-path-conflict"))
    for df in wrong:
        found = found.unionByName(finding(df, "catalog-invalid-date"))
    for d in dates:
        kept = kept.withColumn(d, text.iso_timestamp(F.col(d)))
    return kept.drop("_path", "_rank"), found


def authored(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown and MDX sources: ``path``, ``markdown`` without frontmatter, ``kind``."""
    both = files(spark, folder, ".md").unionByName(files(spark, folder, ".mdx"))
    return both.select(
        F.col("href").alias("path"), text.strip_frontmatter(F.col("body")).alias("markdown"), text.source_kind(F.col("href"), F.lit(True)).alias("kind"), "modified"
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an ownership manifest; lines that are malformed count for nothing."""
    return spark.read.schema(MANIFEST_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("version = 1 AND pathname IS NOT NULL")
