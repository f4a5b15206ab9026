"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six separators of ``[^\x20\x09-\x0D]+`` words.
SPACES = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_DIR = "sitegrain.staging.dir"
#: Where staged tables are, by the identity of their DataFrame while it lives.
_PLACES: dict[int, str] = {}
#: Places of the tables staged in each open ``staging`` block, the innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    session in one process (``local[...]``) gets a temporary folder of its own; on
    a cluster, whose machines would not see it, ``ValueError`` is raised.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_OWN_DIR, None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sitegrain-")
        spark.conf.set(_OWN_DIR, where)
    return where.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of each query that ends meanwhile.

    Else those of a chain of jobs stay until the driver's garbage is collected.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later stages then depend on files that survive a lost executor, and what is
    read several times is computed once.  Give the table to :func:`discard` when
    all that is made from it has been written, or work in a :func:`staging` block.
    What is left goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sitegrain/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = path
    if _OPEN:
        _OPEN[-1].append(path)
    weakref.finalize(out, _PLACES.pop, id(out), None)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by :func:`staged`; others are left alone.

    What has not been written yet must not depend on them.
    """
    for table in tables:
        path = _PLACES.pop(id(table), None)
        if path:
            _delete(table.sparkSession, path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete all tables that are staged in the block when it ends, also by an error.

    Yields a function that keeps one of them, for whoever is outside the block.
    What the block makes must have been written by then, or depend on kept tables
    alone.
    """
    mine: list[str] = []
    _OPEN.append(mine)

    def keep(table: DataFrame) -> DataFrame:
        path = _PLACES[id(table)]
        mine.remove(path)
        if len(_OPEN) > 1:
            _OPEN[-2].append(path)
        return table

    try:
        yield keep
    finally:
        _OPEN.pop()
        for path in mine:
            _delete(spark, path)


def _place(spark: SparkSession, path: str):
    """A path as Hadoop has it, and the file system that it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let the file system delete what is at ``path`` when the driver's JVM ends."""
    place, store = _place(spark, path)
    store.deleteOnExit(place)


def _delete(spark: SparkSession, path: str) -> None:
    place, store = _place(spark, path)
    store.delete(place, True)
    store.cancelDeleteOnExit(place)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    """Number of words as a long; null gives 0."""
    return F.size(word_array(text)).cast("long")


def content_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart; null is like empty."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(1), body).alias("k1"), F.xxhash64(F.lit(2), body).alias("k2")]


def name(column: str) -> Column:
    """The top-level column of that name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(stem: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def whole_row(df: DataFrame, *but: str) -> Column:
    """All columns of ``df`` as one struct, except ``but`` (whose case is ignored).

    Operators carry the caller's columns in it, so that no name of theirs can
    clash with one of the operator's own.
    """
    gone = {c.lower() for c in but}
    kept = [name(c) for c in df.columns if c.lower() not in gone]
    return F.struct(*kept) if kept else F.lit(None).cast("struct<>")


#: Values that keys are reduced to before they are looked for; bounds a broadcast.
BUCKETS = 1 << 20


def maybe_in(df: DataFrame, keys: list[str], known: DataFrame, within: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``keys`` may be among those of ``known``: all that are, and some more.

    ``within=False`` gives the other rows, which surely are not.  Keys are reduced
    to one of ``BUCKETS`` hash values, so what is broadcast is at most that many
    numbers, however many keys there are; a join on the keys has to follow.  It
    keeps wide rows that nobody asks for from being moved.
    """
    mark = unused("_bucket", df)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias(mark)
    held = known.select(bucket).distinct()
    return df.select("*", bucket).join(F.broadcast(held), mark, "left_semi" if within else "left_anti").drop(mark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
