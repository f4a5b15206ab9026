"""Pages as a stream: the batch functions per micro-batch, and what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Site
from ..functions import paths, text
from ..operators import records

RAW = "page_id bigint, url string, html string"


def stream(spark: SparkSession, folder: str, schema: str = RAW) -> DataFrame:
    """Pages arriving as Parquet files."""
    raw = spark.readStream.schema(schema).parquet(folder)
    site, path = paths.site_and_path(F.col("url"))
    return raw.select(site.alias("site"), path.alias("pathname"), F.col("page_id").alias("page_ord"), "url", "html")


def heads(pages: DataFrame) -> DataFrame:
    """Titles and entity tags: stateless, so it is the same for batches and streams."""
    out = records.with_head(pages)
    return out.select("site", "pathname", "page_ord", F.col("head.title").alias("title"), text.etag(F.col("html")).alias("etag"))


def publish(pages: DataFrame, site: Site, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Records of each micro-batch to ``sink(df, batch_id)``, once per batch id."""

    def one(batch: DataFrame, number: int) -> None:
        sink(records.records(batch, site), number)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """Pages that are new or whose entity tag is another, with ``change``."""
    before = known.select("site", "pathname", F.col("etag").alias("before"))
    both = current.join(before, ["site", "pathname"], "left")
    change = F.when(F.col("before").isNull(), "new").when(F.col("before") != F.col("etag"), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").drop("before")
