"""Repeated runs of symbols across a corpus: what substring operators share.

A run of ``K`` symbols (bytes or words of a text) is repeated if its sequence
also starts elsewhere.  Comparing every run would move the corpus several times
over, so each run is told by its *anchor*: the run of ``A`` symbols with the
least hash inside it.  Equal runs have equal anchors, hence

1. anchors that occur once rule out all their runs (about 2 / (K - A) rows per
   symbol are compared, not 1);
2. the *context* of an anchor is the union of its runs; equal contexts repeat as
   a whole, without looking inside;
3. only anchors that meet in different contexts have to be resolved run by run,
   which the operators do each in their own way.

Texts are known by a 128-bit key of their content, so copies of a text are one
thing to compare and a copied text is repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, discard, maybe_in, name, staged, whole_row
from .kernels import _BYTE64, U64, Piece, mix, pieces, powers, run_hash, words

_BITS = U64(26)
_LOW = U64((1 << 26) - 1)
#: Runs of one text that are placed at a time.
_SPAN = 1 << 22
#: Bytes whose anchors are found at a time: their 64-bit hashes stay in a core's cache.
_PIECE = 1 << 16


@dataclass(frozen=True)
class Unit:
    """What the symbols are, how long a run is, and how long its anchor."""

    name: str
    run: int
    anchor: int

    def symbols(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """64-bit symbols of all rows, and the bounds of each row."""
        if self.name == "bytes":
            return _BYTE64[0][piece.data], piece.offsets
        w = words(piece)
        return w.hashes, w.bounds


def anchors(symbols: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(row, first run, last run, anchor hash, context hash) of each anchor.

    Runs are numbered by where they start in their row.  Of equal least hashes
    the rightmost is the anchor, which every copy of the run agrees on.
    """
    found: list[tuple[np.ndarray, ...]] = []
    lengths = np.diff(bounds)
    if lengths.max(initial=0) > _SPAN:
        for row in range(len(lengths)):
            for at in range(0, max(1, int(lengths[row]) - unit.run + 1), _SPAN):
                own = symbols[bounds[row] + at : min(bounds[row + 1], bounds[row] + at + _SPAN + unit.run - 1)]
                r, lo, hi, h, c = _anchors(own, np.array([0, len(own)]), unit)
                found.append((r + row, lo + at, hi + at, h, c))
    else:
        found.append(_anchors(symbols, bounds, unit))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchors(symbols: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    width = unit.run - unit.anchor + 1
    none = np.zeros(0, np.int64)
    if len(symbols) < unit.run:
        return none, none, none, none, none
    hashes = run_hash(symbols, unit.anchor)
    # Hash above, place (from the end) below: the least is the rightmost least.
    keys = (mix(hashes) & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=U64))
    least, have, span, rest = None, 0, 1, width
    while rest:
        if rest & 1:
            if least is None:
                least = keys
            else:
                n = min(len(least), len(keys) - have)
                least = np.minimum(least[:n], keys[have : have + n])
            have += span
        rest >>= 1
        if rest:
            keys = np.minimum(keys[:-span], keys[span:])
            span *= 2
    runs = np.arange(len(least))
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(runs)]
    whole = runs + unit.run <= bounds[rows + 1]
    runs, rows = runs[whole], rows[whole]
    if not len(runs):
        return none, none, none, none, none
    at = (_LOW - (least[whole] & _LOW)).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(runs)) - 1
    at, rows, lo, hi = at[first], rows[first], runs[first], runs[last]
    contexts = _span_hash(symbols, lo, hi + unit.run) + ((at - lo) * 1000003 + (hi - lo)).astype(U64)
    start = bounds[rows]
    return rows, lo - start, hi - start, mix(hashes[at]).view(np.int64), mix(contexts).view(np.int64)


def _span_hash(symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each span by sums of symbols under powers of an odd number."""
    n = len(symbols)
    up, down = powers(n + 1), powers(n + 1, -1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(symbols) * up[:-1])])
    return (sums[hi] - sums[lo]) * down[lo]


_ANCHOR_SCHEMA = "h long, c long, k1 long, k2 long, lo int, hi int"


def anchor_rows(keyed: DataFrame, text: str, unit: Unit) -> DataFrame:
    """Anchors of all texts (``k1``, ``k2``, ``text``); one met again in the same task is left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            fresh = np.zeros(len(k1), bool)
            for n, key in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh[n] = True
            which = np.flatnonzero(fresh)
            k1, k2 = k1[which], k2[which]
            for piece in pieces(batch.column(2).take(pa.array(which)), _PIECE):
                rows, lo, hi, h, c = anchors(*unit.symbols(piece), unit)
                rows = rows + piece.lo
                yield pa.record_batch(
                    [pa.array(x) for x in (h, c, k1[rows], k2[rows], lo.astype(np.int32), hi.astype(np.int32))],
                    ["h", "c", "k1", "k2", "lo", "hi"],
                )

    return keyed.select("k1", "k2", text).mapInArrow(scan, _ANCHOR_SCHEMA)


def shared_anchors(df: DataFrame, text: str, unit: Unit) -> DataFrame:
    """Anchors that occur twice or more, with ``full`` and ``open``; a staged table.

    ``full``: the whole context is found again.  ``open``: the context takes part
    in resolving its anchor, as the one that asks (not full) or as the one of its
    kind that the others are held against.
    """
    rows = anchor_rows(df, text, unit)
    groups = (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
        .filter("n > 1")
        .select("h", (F.col("least") == F.col("most")).alias("alike"))
    )
    # Written first: a join of two plain shuffles can split a frequent anchor.
    groups = staged(groups, "groups")
    shared = staged(rows.join(groups, "h"), "anchors")
    discard(groups)
    mixed = shared.filter("not alike").drop("alike")
    who = F.struct("k1", "k2", "lo", "hi")
    kinds = mixed.groupBy("h", "c").agg(F.min(who).alias("one"), F.max(who).alias("two"))
    kinds = staged(kinds.select("h", "c", (F.col("one") != F.col("two")).alias("full"), "one"), "kinds")
    marked = mixed.join(kinds, ["h", "c"]).select(
        *mixed.columns, "full", (~F.col("full") | (F.col("one") == who)).alias("open")
    )
    alike = shared.filter("alike").drop("alike").select("*", F.lit(True).alias("full"), F.lit(False).alias("open"))
    out = staged(alike.unionByName(marked), "marked")
    discard(shared, kinds)
    return out


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def settle(df: DataFrame, text: str, unit: Unit, resolve: Callable[[DataFrame, str, Unit], DataFrame], *but: str) -> DataFrame:
    """(``row``, ``body``, ``spans``): columns of ``df`` except ``but``, the text, its repeated spans.

    ``spans`` is an array of [lo, hi) in symbols, which may overlap and stand in no
    order; null says that the text is copied, and so repeated as a whole.  A null
    text has no symbols.  ``resolve`` gets the texts with open anchors (``k1``,
    ``k2``, ``text``, ``asks``) and returns (``k1``, ``k2``, ``lo``, ``hi``) spans
    that are found again.

    Texts move twice at most: those with open anchors to be resolved, and those
    with spans to meet them.  Others stay where they are.
    """
    key = ["k1", "k2"]
    body = name(text)
    texts = df.select(*content_key(body), body.alias("text"))
    marked = shared_anchors(texts, "text", unit)
    asks = marked.filter("open").groupBy(*key).agg(F.collect_set(F.struct("h", "lo", "hi", "full")).alias("asks"))
    asks = staged(asks, "asks")
    source = maybe_in(texts, key, asks).join(asks, key)
    solved = staged(resolve(source, "text", unit), "solved")
    discard(asks)
    copies = staged(texts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), "copies")
    full = marked.filter("full").select(*key, "lo", (F.col("hi") + unit.run).cast("int").alias("hi"))
    spans = full.unionByName(solved).join(copies, key, "left_anti").groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    facts = staged(spans.unionByName(copies.withColumn("spans", F.lit(None).cast(_SPANS))), "spans")
    discard(marked, solved, copies)
    rows = df.select(*content_key(body), whole_row(df, *but).alias("row"), body.alias("body"))
    none = F.array().cast(_SPANS)
    met = maybe_in(rows, key, facts).join(facts.withColumn("found", F.lit(True)), key, "left")
    met = met.select("row", "body", F.when(F.col("found"), F.col("spans")).otherwise(none).alias("spans"))
    return met.unionByName(maybe_in(rows, key, facts, within=False).select("row", "body", none.alias("spans")))


_SPANS = "array<struct<lo:int,hi:int>>"
