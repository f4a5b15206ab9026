"""Substring dedup over words: level-wise doubling of repeated windows.

Windows of 9 words that are repeated are alone extended to 18, those alone to
35 (two of 18 that share a word), the length that is asked for.  The first level
looks at one window in each run of 35 (its anchor, see :mod:`repeats`), the later
ones at the windows around anchors that survived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .common import staged
from .kernels import U64, mix, pieces, run_hash, words

UNIT = repeats.Unit("words", 35, 9)
_MIDDLE = 18
_LOW = U64((1 << 26) - 1)
#: Windows that are placed at a time.
_PART = 1 << 22


def window_rows(source: DataFrame, text: str, unit: repeats.Unit) -> DataFrame:
    """Windows of all open anchors: (``half``, ``key``, ``k1``, ``k2``, ``at``, ``who``, ``asks``).

    ``half`` is the hash of the 18 words around the anchor (within the window),
    ``key`` that of all 35; together they tell windows apart.  ``who`` is the
    place, so that a text that is met twice does not repeat itself.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            asks = batch.column(3)
            starts = asks.offsets.to_numpy()
            flat = asks.values
            lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
            full = flat.field("full").to_numpy(zero_copy_only=False)
            for piece in pieces(batch.column(2)):
                symbols, bounds = unit.symbols(piece)
                key, half = run_hash(symbols, unit.run), run_hash(symbols, _MIDDLE)
                order = mix(run_hash(symbols, unit.anchor))
                a, b = starts[piece.lo], starts[piece.hi]
                counts = (hi[a:b] - lo[a:b] + 1).astype(np.int64)
                row = np.repeat(np.arange(piece.lo, piece.hi), np.diff(starts[piece.lo : piece.hi + 1]))
                row = np.repeat(row, counts)
                heads = np.cumsum(counts) - counts
                at = np.arange(counts.sum()) - np.repeat(heads - lo[a:b], counts)
                here = at + bounds[row - piece.lo]
                centre = _around(order, here, unit)
                who = mix(k1[row].view(U64) ^ mix(k2[row].view(U64) + at.astype(U64))).view(np.int64)
                yield pa.record_batch(
                    [
                        pa.array(x)
                        for x in (
                            mix(half[centre]).view(np.int64), mix(key[here]).view(np.int64), k1[row], k2[row], at.astype(np.int32), who, ~np.repeat(full[a:b], counts),
                        )
                    ],
                    ["half", "key", "k1", "k2", "at", "who", "asks"],
                )

    return source.select("k1", "k2", text, "asks").mapInArrow(scan, "half long, key long, k1 long, k2 long, at int, who long, asks boolean")


def _around(order: np.ndarray, here: np.ndarray, unit: repeats.Unit) -> np.ndarray:
    """Start of the 18 words around the anchor of each window, inside the window."""
    width = unit.run - unit.anchor + 1
    out = np.empty(len(here), np.int64)
    # Hash above, place (from the end) in 26 bits below; so a very long text is
    # looked at by parts, of which each window has all its own.
    for lo in range(0, len(order), _PART):
        inside = np.flatnonzero((here >= lo) & (here < lo + _PART))
        if not len(inside):
            continue
        part, at = order[lo : lo + _PART + width], here[inside] - lo
        keys = (part & ~_LOW) | (_LOW - np.arange(len(part), dtype=U64))
        least = keys[at]
        for k in range(1, width):
            np.minimum(least, keys[at + k], out=least)
        anchor = (_LOW - (least & _LOW)).astype(np.int64)
        out[inside] = lo + np.clip(anchor - (_MIDDLE - unit.anchor) // 2, at, at + unit.run - _MIDDLE)
    return out


def surviving(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys stand at two places or more.

    The keys are aggregated where they are before they meet, so a frequent window
    is a row per task, and written; the rows then meet their key in a join of two
    plain shuffles, whose large partitions can be split.
    """
    again = rows.groupBy(*keys).agg(F.min("who").alias("one"), F.max("who").alias("two")).filter("one != two").select(*keys)
    return rows.join(staged(again, "again"), keys)


def resolve(source: DataFrame, text: str, unit: repeats.Unit) -> DataFrame:
    """Repeated windows of open anchors, by doubling from 9 to 18 to 35 words."""
    rows = window_rows(source, text, unit)
    longer = staged(surviving(rows, ["half"]), "windows")
    found = surviving(longer, ["half", "key"]).filter("asks")
    return found.select("k1", "k2", F.col("at").alias("lo"), (F.col("at") + unit.run).alias("hi")).distinct()


def repeated_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: words covered by a repeated window of 35, as [lo, hi) runs.

    A null list means that every word of a text of 35 words or more is covered
    (the text itself is copied).  Spans may overlap and stand in no order;
    :func:`cut` merges them.  Null, empty and shorter texts have none.
    """
    return repeats.settle(df, text, UNIT, resolve, "spans").select("row.*", "spans")


_CUT = "n_words long, n_removed long, kept string"


def cut(df: DataFrame, text: str = "text", hashed: bool = False) -> DataFrame:
    """Remove repeated words: adds ``n_words``, ``n_removed`` and ``kept``.

    ``kept`` is the other words joined by one space, or with ``hashed`` the
    SHA-256 of that, and the text is not returned.  A null or empty text has no
    words and an empty ``kept``; texts below 35 words keep all; of texts that are
    repeated, in rows of their own or as repeated rows, each loses every word.
    Columns with the names of those added are replaced; all others pass through,
    whatever they are called.  An empty table gives an empty result.
    """
    rows = repeats.settle(df, text, UNIT, resolve, "n_words", "n_removed", "kept", *([text] if hashed else []))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(_CUT).fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            whole = spans.is_null().to_numpy(zero_copy_only=False)
            starts = spans.offsets.to_numpy()
            lo, hi = (spans.values.field(x).to_numpy() for x in ("lo", "hi"))
            totals, gone, kept = [], [], []
            for piece in pieces(batch.column(1)):
                w = words(piece)
                raw = bytes(piece.data)
                for k in range(piece.hi - piece.lo):
                    r = piece.lo + k
                    first, last = int(w.bounds[k]), int(w.bounds[k + 1])
                    n = last - first
                    if whole[r]:
                        a, b = (np.array([0]), np.array([n])) if n >= UNIT.run else (lo[:0], lo[:0])
                    else:
                        a, b = repeats.merge(lo[starts[r] : starts[r + 1]], hi[starts[r] : starts[r + 1]])
                    drop = np.zeros(n, bool)
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        drop[x:y] = True
                    left = np.flatnonzero(~drop) + first
                    out = b" ".join([raw[x:y] for x, y in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)])
                    totals.append(n)
                    gone.append(n - len(left))
                    kept.append(hashlib.sha256(out).hexdigest() if hashed else out.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_words", "n_removed", "kept"],
            )

    return rows.mapInArrow(scan, schema).select("row.*", "n_words", "n_removed", "kept")


def digest(df: DataFrame) -> DataFrame:
    """One row per document: words, words removed, SHA-256 of the rest."""
    return cut(df.select("doc_id", "text"), hashed=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
