"""Global shuffle into shards by a two-pass external shuffle (native).

Pass one scatters rows uniformly, by a seeded hash, into as many buckets as it
takes for one to fit in memory.  Pass two shuffles each bucket by Fisher-Yates
(``shuffle`` draws its permutation so) and lays the buckets end to end; shards
are equal slices of that order.  Buckets grow in number with the data, never in
size, and whatever happens inside one is bounded by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import maybe_in, name, staged, whole_row

#: What a row counts for besides its text, in bytes.
ROW_BYTES = 16
#: Copies of one row that are made again in one place.
COPIES = 1 << 12


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus 16; null has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _spread(rows: DataFrame) -> DataFrame:
    """Add ``copy``: 0, or for rows that are alike in ``h1`` and ``h2`` 0, 1, 2, ...

    Rows that are alike are counted before they meet, one of them is kept per
    task, and the count makes the copies again, ``COPIES`` of them in a place; so
    any number of them is dealt to as many buckets, no task has to make them all,
    and it makes no difference which of them was where.
    """
    key = ["h1", "h2"]
    alike = common.staged(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "alike")
    zero = F.lit(0).cast("long").alias("copy")
    alone = maybe_in(rows, key, alike, within=False).select("*", zero)
    others = maybe_in(rows, key, alike)
    once = others.join(alike.select(*key), key, "left_anti").select(*rows.columns, zero)
    one = others.join(alike.select(*key), key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
    part = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))
    dealt = one.join(alike, key).select(*rows.columns, "n", F.explode(part).alias("part")).repartition(*key, "part")
    begin = F.col("part") * COPIES
    again = dealt.select(*rows.columns, F.explode(F.sequence(begin, F.least("n", begin + COPIES) - 1)).alias("copy"))
    return alone.unionByName(once).unionByName(again)


def shuffle_to_shards(
    df: DataFrame,
    shards: int,
    key: list[str],
    size: str | None = None,
    seed: int = 17,
    bucket_bytes: int = 8 << 20,
    bucket_rows: int = 1 << 12,
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each).

    Shards hold contiguous runs of one seeded permutation of all rows, so their
    row counts differ by one at most.  A bucket holds about ``bucket_bytes`` (by
    the column ``size``, where given) and ``bucket_rows`` at most on average.

    Rows are scattered by a hash of the ``key`` columns and of all others, so rows
    that agree in the key are spread; repeated rows are numbered and spread too.
    Nulls hash like any value, an empty table gives an empty result, and the same
    rows and seed give the same shards, however they are laid out in files.
    Columns called ``shard`` or ``slot`` are replaced; all others pass through,
    whatever they are called.
    """
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(name(size)).alias("b") if size else F.lit(0).alias("b")).first()
    rows = totals["n"] or 0
    buckets = max(1, -(-rows // bucket_rows), -(-(totals["b"] or 0) // bucket_bytes))
    row = whole_row(df, "shard", "slot")
    hashed = _spread(df.select(row.alias("row"), *(F.xxhash64(F.lit(seed + k), *(name(c) for c in key), row).alias(f"h{k}") for k in (1, 2))))
    # Pass one.  The hashes order a bucket too, so that the permutation does not
    # depend on the order in which rows arrive.
    scattered = hashed.select(
        F.pmod(F.xxhash64(F.lit(seed), "h1", "copy"), F.lit(buckets)).alias("bucket"), F.struct("h1", "h2", "copy", "row").alias("item")
    )
    # Pass two.  ``shuffle`` seeds its generator by partition and draws on from
    # bucket to bucket, so partitions and the order within them are fixed.
    width = max(1, min(buckets, 1 << 15))

    def by_hash(a: Column, b: Column) -> Column:
        order = F.lit(0)
        for k in ("copy", "h2", "h1"):
            order = F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(order)
        return order

    packed = (
        scattered.repartition(width, "bucket")
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list("item"), by_hash).alias("items"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.size("items").alias("held"), F.shuffle(F.col("items"), F.lit(seed)).alias("items"))
    )
    packed = staged(packed, "shards")
    return _laid_out(packed, rows, shards)


def _laid_out(packed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Give every row of the shuffled buckets its shard and slot."""
    # Where each bucket starts.  There is one row per bucket, so buckets are
    # counted by group first and the prefix sums stay short at any size.
    held = packed.select("bucket", "held")
    group = F.floor(F.col("bucket") / 1024)
    from pyspark.sql import Window

    sums = held.groupBy(group.alias("group")).agg(F.sum("held").alias("total"))
    before_group = sums.select(
        "group", (F.sum("total").over(Window.orderBy("group")) - F.col("total")).alias("before_group")
    )
    starts = (
        held.withColumn("group", group)
        .withColumn("inner", F.sum("held").over(Window.partitionBy("group").orderBy("bucket")) - F.col("held"))
        .join(before_group, "group")
        .select("bucket", (F.col("before_group") + F.col("inner")).alias("start"))
    )
    placed = packed.join(starts, "bucket").select("start", F.posexplode("items").alias("at", "item"))
    place = F.col("start") + F.col("at")
    # The first rows % shards shards hold one row more.
    small, more = divmod(rows, shards)
    edge = more * (small + 1)
    at = F.col("place")
    return placed.select(place.alias("place"), F.col("item")["row"].alias("row")).select(
        "row.*",
        F.when(at < edge, F.floor(at / (small + 1))).otherwise(more + F.floor((at - edge) / max(small, 1))).cast("int").alias("shard"),
        F.when(at < edge, at % (small + 1)).otherwise((at - edge) % max(small, 1)).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows as Parquet under ``path/shard=k``, each shard in slot order.

    A shard is one file, written by one task that streams it; ``shards`` is to be
    chosen so that a shard is as large as a file should be.  Nulls and repeated
    rows are written as they are; an empty table writes no shard.
    """
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(df: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: size, CRC of the text, shard and slot.

    Texts are scattered, shuffled and written with their ids; size and CRC are
    those of the texts that come out of the written buckets.
    """
    # ``need`` sizes the buckets and ``tie`` tells apart rows that share an id.
    rows = df.select(
        "doc_id",
        "text",
        text_bytes(F.col("text")).alias("need"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie"),
    )
    return shuffle_to_shards(rows, shards, ["doc_id", "tie"], "need").select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
