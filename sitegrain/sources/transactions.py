"""File transactions: writes and deletes of many files under one folder, all or none.

Tasks do the work, the driver sees counts and the first fault only:

1. *stage*: every body is written under ``<root>/.transaction-<id>/new``; the list of
   operations, with what was there before, becomes the journal.  No destination has
   been touched, so a failure only drops the transaction's folder.
2. *apply*: what is there moves to ``old``, the new file to its place.  Both steps ask
   first what has been done, so a task that runs again after a lost executor goes on
   where the first stopped.  Tasks do not raise, they report: all have
   ended before anything is taken back.
3. *commit*: the marker ``APPLIED``, then the folder goes.  Or *roll back* from the
   journal, as often as needed; :func:`recover` does so for a driver that died.

Moves stay within one file system, where they are renames; on a local disk they are
a link and an unlink, as renames between folders wait there for one another.  A task
may end between the two, so one file can have both names when another goes on.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as _fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import check_destinations

_FOLDER = ".transaction-"
_JOURNAL = "kind string, path string, staged string, etag string, bytes long, existed boolean, error string"
_NAMES = ["kind", "path", "staged", "etag", "bytes", "existed", "error"]


class TransactionError(Exception):
    """A transaction that was taken back; ``restored`` says whether wholly."""

    def __init__(self, message: str, restored: bool = True):
        super().__init__(message)
        self.restored = restored


def at(root: str) -> tuple[_fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI."""
    system, path = _fs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def fault(path: str) -> str | None:
    """Why a relative path can be no destination, or null."""
    parts = path.split("/")
    if not path or path.startswith("/") or "\\" in path or any(p in ("", ".", "..") for p in parts):
        return "unsafe path"
    return "reserved name" if parts[0].startswith(_FOLDER) else None


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out by path, as each means work on a file, however few bytes they are."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "path")


def _there(system: _fs.FileSystem, path: str) -> _fs.FileType:
    return system.get_file_info(path).type


def _confined(system: _fs.FileSystem, base: str, path: str, seen: set[tuple[str, str]] | None = None) -> None:
    """A link among a file's folders may not lead out of the root.

    ``seen`` has the folders that the same batch has asked about.
    """
    seen, here = set() if seen is None else seen, ("within", path.rpartition("/")[0])
    if isinstance(system, _fs.LocalFileSystem) and here not in seen:
        parent, top = os.path.realpath(os.path.dirname(path)), os.path.realpath(base)
        if parent != top and not parent.startswith(top + os.sep):
            raise TransactionError(f"{path} leads out of {base}")
        seen.add(here)


def _hashed(path: str) -> str:
    """Where a path's file stands in a folder of a transaction: dealt out to 256 folders."""
    name = hashlib.sha256(path.encode()).hexdigest()
    return f"{name[:2]}/{name}"


def _made(system: _fs.FileSystem, folder: str, seen: set[tuple[str, str]] | None) -> None:
    if seen is None or ("made", folder) not in seen:
        system.create_dir(folder, recursive=True)
        if seen is not None:
            seen.add(("made", folder))


def _same(system: _fs.FileSystem, one: str, other: str) -> bool:
    """Whether two names stand for one file: a move that ended half-way."""
    try:
        return isinstance(system, _fs.LocalFileSystem) and os.path.samestat(os.lstat(one), os.lstat(other))
    except FileNotFoundError:
        return False


def _move(system: _fs.FileSystem, path: str, to: str) -> None:
    """Move a file, in place of what is there, or go on with such a move."""
    if isinstance(system, _fs.LocalFileSystem):
        try:
            os.link(path, to, follow_symlinks=False)
            linked = True
        except OSError:
            # Where there can be no link, or something else is in its place, it is a rename.
            linked = _same(system, path, to)
        if linked:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(path)
            return
    system.move(path, to)


def _one(system: _fs.FileSystem, base: str, folder: str, kind: str, path: str, body: bytes, seen: set[tuple[str, str]] | None = None) -> tuple:
    """Stage one operation: (staged, etag, bytes, existed)."""
    if reason := fault(path):
        raise TransactionError(reason)
    _confined(system, base, f"{base}/{path}", seen)
    was = _there(system, f"{base}/{path}")
    if was == _fs.FileType.Directory:
        raise TransactionError("is a folder")
    existed = was == _fs.FileType.File
    if kind != "write":
        return None, None, None, existed
    staged = _hashed(path)
    _made(system, f"{folder}/{staged[:2]}", seen)
    with system.open_output_stream(f"{folder}/{staged}") as out:
        out.write(body)
    return staged, f'"{hashlib.sha256(body).hexdigest()}"', len(body), existed


def _stage(root: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = at(root)
        folder = f"{base}/{_FOLDER}{name}/new"
        system.create_dir(folder, recursive=True)
        for batch in batches:
            rows: list[tuple] = []
            seen: set[tuple[str, str]] = set()
            for kind, path, body in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    rows.append((kind, path, *_one(system, base, folder, kind, path, body or b"", seen), None))
                except Exception as error:
                    rows.append((kind, path, None, None, None, None, str(error)))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.bool_(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    return run


def _each(root: str, name: str, act: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Do ``act`` for each operation of a task until one fails; yields (path, error) of that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = at(root)
        for batch in batches:
            seen: set[tuple[str, str]] = set()
            for row in batch.to_pylist():
                try:
                    act(system, base, f"{base}/{_FOLDER}{name}", row, seen)
                except Exception as error:
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([f"{type(error).__name__}: {error}"])], ["path", "error"])
                    return

    return run


def _backup(folder: str, path: str) -> str:
    return f"{folder}/old/{_hashed(path)}"


def _apply(before: Callable[[str], None] | None) -> Callable:
    def act(system: _fs.FileSystem, base: str, folder: str, row: dict, seen: set[tuple[str, str]] | None = None) -> None:
        path, new, old = f"{base}/{row['path']}", f"{folder}/new/{row['staged']}", _backup(folder, row["path"])
        if before is not None:
            before(row["path"])
        _confined(system, base, path, seen)
        waiting = row["kind"] == "delete" or _there(system, new) == _fs.FileType.File
        if row["existed"] and (_there(system, old) == _fs.FileType.NotFound or _same(system, path, old)):
            _made(system, old.rpartition("/")[0], seen)
            _move(system, path, old)
        elif not row["existed"] and waiting and _there(system, path) != _fs.FileType.NotFound and not _same(system, new, path):
            raise TransactionError(f"{row['path']} appeared meanwhile")
        if row["kind"] == "write" and waiting:
            _made(system, path.rpartition("/")[0], seen)
            _move(system, new, path)

    return act


def _undo(system: _fs.FileSystem, base: str, folder: str, row: dict, seen: set[tuple[str, str]] | None = None) -> None:
    path, old = f"{base}/{row['path']}", _backup(folder, row["path"])
    new = f"{folder}/new/{row['staged']}"
    installed = row["kind"] == "write" and (_there(system, new) == _fs.FileType.NotFound or _same(system, new, path))
    if installed and _there(system, path) == _fs.FileType.File and (not row["existed"] or _there(system, old) == _fs.FileType.File):
        system.delete_file(path)
    if row["existed"] and _there(system, old) == _fs.FileType.File:
        _move(system, old, path)


def _drop(system: _fs.FileSystem, base: str, folder: str, row: dict, seen: set[tuple[str, str]] | None = None) -> None:
    """Delete what was there before, once all is committed."""
    old = _backup(folder, row["path"])
    if _there(system, old) == _fs.FileType.File:
        system.delete_file(old)


def _first_error(rows: DataFrame) -> str | None:
    found = rows.agg(F.min(F.concat_ws(": ", "path", "error")).alias("error")).first()
    return found.error


def roll_back(spark: SparkSession, root: str, name: str) -> None:
    """Restore what the journal of a transaction says was there, and drop its folder."""
    system, base = at(root)
    folder = f"{base}/{_FOLDER}{name}"
    if _there(system, f"{folder}/journal/_SUCCESS") == _fs.FileType.File:
        journal = spark.read.schema(_JOURNAL).parquet(f"{root.rstrip('/')}/{_FOLDER}{name}/journal").where("error IS NULL")
        if error := _first_error(spread(journal).mapInArrow(_each(root, name, _undo), "path string, error string")):
            raise TransactionError(f"could not restore {error}; what was there is kept in {folder}", restored=False)
    if _there(system, folder) != _fs.FileType.NotFound:
        system.delete_dir(folder)


def recover(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """Finish transactions whose driver died: (name, ``kept`` or ``rolled back``)."""
    system, base = at(root)
    out = []
    for info in system.get_file_info(_fs.FileSelector(base, allow_not_found=True)):
        if info.base_name.startswith(_FOLDER):
            name = info.base_name.removeprefix(_FOLDER)
            if _there(system, f"{info.path}/APPLIED") == _fs.FileType.File:
                system.delete_dir(info.path)
                out.append((name, "kept"))
            else:
                roll_back(spark, root, name)
                out.append((name, "rolled back"))
    return sorted(out)


def commit(
    operations: DataFrame, root: str, name: str | None = None, before_apply: Callable[[str], None] | None = None, then: Callable[[], None] | None = None
) -> int:
    """Carry out operations (kind, path, body) under ``root``; the number of them.

    ``kind`` is write or delete, ``path`` relative to the root, ``body`` text or
    bytes.  Two of one path, or one inside another, are refused before anything is
    written.  ``before_apply`` is called with each path in the tasks, ``then`` at the
    end on the driver; if either raises, all is as it was.
    """
    spark = operations.sparkSession
    name = name or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]{0,127}", name):
        raise ValueError(f"no name for a transaction: {name}")
    problem = check_destinations(operations.select(F.lit("").alias("site"), F.concat(F.lit("/"), "path").alias("dest"))).limit(1).collect()
    if problem:
        raise TransactionError(f"destinations collide: {problem[0].problem} at {problem[0].dest}")
    system, base = at(root)
    folder = f"{base}/{_FOLDER}{name}"
    if _there(system, folder) != _fs.FileType.NotFound:
        raise TransactionError(f"{folder} is there already")
    try:
        journal = f"{root.rstrip('/')}/{_FOLDER}{name}/journal"
        spread(operations.select("kind", "path", F.col("body").cast("binary"))).mapInArrow(_stage(root, name), _JOURNAL).write.parquet(journal)
        staged = spark.read.schema(_JOURNAL).parquet(journal)
        if error := _first_error(staged.where("error IS NOT NULL")):
            raise TransactionError(error)
        if error := _first_error(spread(staged).mapInArrow(_each(root, name, _apply(before_apply)), "path string, error string")):
            raise TransactionError(error)
        done = staged.count()
        if then is not None:
            then()
        with system.open_output_stream(f"{folder}/APPLIED"):
            pass
    except BaseException:
        roll_back(spark, root, name)
        raise
    # Tasks delete the files; what they could not goes with the folder.
    with contextlib.suppress(Exception):
        spread(staged.where("existed")).mapInArrow(_each(root, name, _drop), "path string, error string").count()
    system.delete_dir(folder)
    return done


def fingerprints(paths: DataFrame, root: str) -> DataFrame:
    """(path, etag) of the files among ``paths`` (one column ``path``) that are there; only those are read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = at(root)
        for batch in batches:
            names, tags = [], []
            for path in batch.column(0).to_pylist():
                if fault(path) is None and _there(system, f"{base}/{path}") == _fs.FileType.File:
                    with system.open_input_stream(f"{base}/{path}") as body:
                        told = hashlib.sha256()
                        while chunk := body.read(1 << 20):
                            told.update(chunk)
                    names.append(path)
                    tags.append(f'"{told.hexdigest()}"')
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tags, pa.string())], ["path", "etag"])

    return spread(paths.select("path")).mapInArrow(scan, "path string, etag string")


def replace_each(rows: DataFrame, root: str) -> int:
    """Put bodies (path, body) in place one by one, each whole or not at all; the number that failed.

    For what has to be done where it can be, such as redactions after a failure.
    """

    def act(system: _fs.FileSystem, base: str, folder: str, row: dict, seen: set[tuple[str, str]] | None = None) -> None:
        _confined(system, base, f"{base}/{row['path']}", seen)
        beside = f"{folder}-{hashlib.sha256(row['path'].encode()).hexdigest()}"
        with system.open_output_stream(beside) as out:
            out.write(row["body"])
        system.move(beside, f"{base}/{row['path']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _each(root, "single", act)(iter([batch.slice(k, 1)]))

    return rows.select("path", F.col("body").cast("binary")).mapInArrow(run, "path string, error string").count()
