"""Suffix-array dedup over bytes: bounded interval expansion on a BWT.

Open contexts (see :mod:`repeats`) of one anchor are put together and cut back to
what any two of them share around it; what is left short of 400 bytes holds no
repeat.  The others are joined into a text of a few MB, and the Burrows-Wheeler
transform of that is expanded breadth first: an interval of suffixes that share a
string is extended to the left by every byte that occurs there, so the boundaries
between suffixes are found by increasing common prefix.  It stops at 400;
suffixes that no boundary parts by then share 400 bytes.

Only strings of 400 bytes are removed.  What contexts share around their anchor is
reported from ``PASSAGE`` bytes on, which tells of shorter passages that repeat.
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
from .common import discard, staged
from .kernels import _BYTE64, mix, pieces, run_hash

UNIT = repeats.Unit("bytes", 400, 64)
#: Bytes that are transformed at a time, if a group of contexts allows.
CHUNK = 2 << 20
#: Contexts of an anchor up to which they are resolved in one place (0.75 MB at most).
GROUP = 1024
#: Bytes from which a shared stretch is reported, though it is not removed.
PASSAGE = 250


def suffix_array(symbols: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array by prefix doubling; only ties are sorted again.

    With ``depth``, suffixes that share so many symbols may stand in any order.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(3, np.int64)])
    bits = int(padded.max()).bit_length()
    step = 1
    key = padded[:n].copy()
    for k in range(1, 4):
        if bits * (k + 1) <= 62:
            key = (key << bits) | padded[k : n + k]
            step = k + 1
    order = np.argsort(key)
    ranked = key[order]
    first = np.append(True, ranked[1:] != ranked[:-1])
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    while True:
        # Places of the order whose rank is not theirs alone.
        alone = first & np.append(first[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_) or (depth is not None and step >= depth):
            return order
        at = order[open_]
        base = rank[at]
        ahead = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = base * (n + 2) + ahead
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        new = np.append(True, key[1:] != key[:-1])
        first[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        step *= 2


def repeated_starts(symbols: np.ndarray, separators: int, run: int) -> np.ndarray:
    """Which positions start a run of symbols that also starts elsewhere.

    Symbols below ``separators`` each occur once; no run crosses them.
    """
    n = len(symbols)
    array = suffix_array(symbols, run + 1)
    last = symbols[array - 1]
    order = np.argsort(last, kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    common = np.full(n + 1, -1, np.int32)
    common[: separators + 1] = 0
    common[n] = 0
    low, high = np.array([0]), np.array([n])
    for length in range(run):
        if not len(low):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        keep = last[at] >= separators
        at, owner = at[keep], owner[keep]
        key = owner * n + back[at]
        key.sort()
        if not len(key):
            break
        owner, place = np.divmod(key, n)
        symbol = symbols[array[place]]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])))
        low, high = place[first], place[np.append(first[1:], len(place)) - 1] + 1
        new = (common[low] < 0) | (common[high] < 0)
        low, high = low[new], high[new]
        for edge in (low, high):
            common[edge[common[edge] < 0]] = length
    first = np.flatnonzero(common[:n] >= 0)
    sizes = np.diff(np.append(first, n))
    out = np.zeros(n, bool)
    out[array[np.repeat(sizes > 1, sizes)]] = True
    # A run ends before the next separator.
    ends = np.append(np.flatnonzero(symbols < separators), n)
    room = ends[np.searchsorted(ends, np.arange(n), side="left")] - np.arange(n)
    return out & (room >= run)


_CONTEXT = "h long, k1 long, k2 long, lo int, asks boolean, body binary"


def contexts(source: DataFrame, text: str, unit: repeats.Unit) -> DataFrame:
    """The bytes around each open anchor, once per text and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = (batch.column(i).to_pylist() for i in (0, 1))
            asks = batch.column(3)
            starts = asks.offsets.to_pylist()
            flat = asks.values
            h, lo, hi = (flat.field(x).to_pylist() for x in ("h", "lo", "hi"))
            full = flat.field("full").to_pylist()
            for piece in pieces(batch.column(2)):
                raw = bytes(piece.data)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for r in range(piece.lo, piece.hi):
                    if (k1[r], k2[r]) in seen:
                        continue
                    seen.add((k1[r], k2[r]))
                    base = int(piece.offsets[r - piece.lo])
                    for j in range(starts[r], starts[r + 1]):
                        for to, x in zip(out, (h[j], k1[r], k2[r], lo[j], not full[j], raw[base + lo[j] : base + hi[j] + unit.run]), strict=True):
                            to.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["h", "k1", "k2", "lo", "asks", "body"])

    return source.select("k1", "k2", text, "asks").mapInArrow(scan, _CONTEXT)


_SOLVED = "k1 long, k2 long, lo int, hi int"


def _common(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Most leading bytes that each row (padded to one width) shares with another of its group.

    Rows are sorted; the longest common prefix is with a neighbour.  -1: it is alone.
    """
    raw = [rows[k, :n].tobytes() for k, n in enumerate(sizes.tolist())]
    of = group.tolist()
    order = np.array(sorted(range(len(of)), key=lambda k: (of[k], raw[k])))
    one, two = order[:-1], order[1:]
    differ = rows[one] != rows[two]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    shared = np.minimum(shared, np.minimum(sizes[one], sizes[two]))
    shared[group[one] != group[two]] = -1
    best = np.full(len(of), -1)
    best[one] = shared
    best[two] = np.maximum(best[two], shared)
    return best


def cut_back(group: np.ndarray, bodies: list[bytes], unit: repeats.Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """[lo, hi) of each context beyond which it holds no repeat; empty if it is alone.  And where its anchor is.

    Contexts of a group have its anchor in common.  A run that two of them share
    has its anchor at one place in it, so it reaches no further to either side of
    the anchor than the contexts agree there.
    """
    m, width = len(bodies), unit.run - unit.anchor
    lengths = np.array([len(b) for b in bodies])
    heads = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(bodies), np.uint8)
    owner = np.repeat(np.arange(m), lengths)
    near = mix(run_hash(_BYTE64[0][data], unit.anchor)).view(np.int64)
    place = np.flatnonzero(near == group[owner[: len(near)]])
    # The anchor lies in every run of its context.
    offset = place - heads[owner[place]]
    place = place[(offset <= width) & (offset >= lengths[owner[place]] - unit.run)]
    at = np.zeros(m, np.int64)
    np.maximum.at(at, owner[place], place - heads[owner[place]])
    reach = []
    for size, first, step in ((at, heads + at - 1, -1), (lengths - at - unit.anchor, heads + at + unit.anchor, 1)):
        rows = np.zeros((m, width), np.uint8)
        row = np.repeat(np.arange(m), size)
        column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        rows[row, column] = data[first[row] + step * column]
        reach.append(_common(group, rows, size))
    left, right = reach
    return np.where(left >= 0, at - left, 0), np.where(left >= 0, at + unit.anchor + right, 0), at


#: Steps from the anchor by which shared stretches are measured, in groups of any size.
STEP = 16


def in_steps(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, unit: repeats.Unit) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) around an anchor at ``at``, either side cut down to whole steps."""
    end = at + unit.anchor
    return np.where(hi > lo, at - (at - lo) // STEP * STEP, 0), np.where(hi > lo, end + (hi - end) // STEP * STEP, 0)


def _expand(rows: DataFrame, unit: repeats.Unit) -> DataFrame:
    """Resolve whole groups of contexts, which stand together, by the BWT.

    Spans shorter than a run are what a context shares with others around its
    anchor.  It may be two partners' halves: whether a run of the whole length
    repeats is decided by the BWT, so they are made shorter than one.
    """

    def repeated(held: list[tuple]) -> pa.RecordBatch:
        m = len(held)
        lengths = np.array([len(r[5]) for r in held])
        heads = np.cumsum(lengths + 1) - lengths - 1
        symbols = np.zeros(int(lengths.sum()) + m, np.int32)
        body = np.ones(len(symbols), bool)
        tails = heads + lengths
        body[tails] = False
        symbols[body] = np.frombuffer(b"".join(r[5] for r in held), np.uint8).astype(np.int32) + m
        symbols[tails] = np.arange(m)
        starts = repeated_starts(symbols, m, unit.run)
        edge = np.diff(np.concatenate([[0], starts.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(heads, first, side="right") - 1
        asks = np.array([r[4] for r in held])[of]
        of, first, last = of[asks], first[asks], last[asks]
        base = np.array([r[3] for r in held])[of] - heads[of]
        keys = (np.array([r[k] for r in held], np.int64)[of] for k in (1, 2))
        return pa.record_batch([*keys, (base + first).astype(np.int32), (base + last - 1 + unit.run).astype(np.int32)], ["k1", "k2", "lo", "hi"])

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        unique = list({(r[1], r[2], r[3]): r for r in held}.values())
        lo, hi, at = cut_back(np.array([r[0] for r in unique], np.int64), [r[5] for r in unique], unit)
        low, high = in_steps(lo, hi, at, unit)
        begin = np.array([r[3] for r in unique], np.int64)
        near = np.flatnonzero(np.array([r[4] for r in unique]) & (high - low >= PASSAGE))
        left = [(*r[:3], r[3] + a, r[4], r[5][a:b]) for r, a, b in zip(unique, lo.tolist(), hi.tolist(), strict=True) if b - a >= unit.run]
        if left:
            yield repeated(left)
        if len(near):
            keys = (np.array([unique[k][j] for k in near.tolist()], np.int64) for j in (1, 2))
            ends = ((begin + x)[near].astype(np.int32) for x in (low, np.minimum(high, low + unit.run - 1)))
            yield pa.record_batch([*keys, *ends], ["k1", "k2", "lo", "hi"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= CHUNK and row[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from solve(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(scan, _SOLVED)


def _anchor_at(data: np.ndarray, h: int, unit: repeats.Unit) -> int:
    """Where the anchor of hash ``h`` is in its context."""
    near = mix(run_hash(_BYTE64[0][data], unit.anchor)[: unit.run - unit.anchor + 1]).view(np.int64)
    return int(np.flatnonzero(near == h)[-1])


#: Runs to a cell, level by level, where frequent anchors are resolved.
CELLS = (32, 4, 1)
_CELL = "c1 long, c2 long, g1 long, g2 long, who long, k1 long, k2 long, lo int, first int, last int, asks boolean"


def _cells(rows: DataFrame, unit: repeats.Unit, step: int) -> DataFrame:
    """Cells of ``step`` runs each: (h, k1, k2, lo, asks, body, ranges) to ``_CELL`` rows.

    Cells are counted from the anchor, so equal runs are in equal cells.  ``c1``,
    ``c2`` is the hash of the bytes that all runs of the cell share; ``g1``, ``g2``
    that of the bytes that any of this row's runs in it has.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(11))
            h, k1, k2, lo, asks = (batch.column(i).to_pylist() for i in range(5))
            ranges = batch.column(6).to_pylist()
            for r, body in enumerate(batch.column(5)):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                anchor = _anchor_at(data, h[r], unit)
                for span in ranges[r]:
                    first = span["first"]
                    while first <= span["last"]:
                        # Of all runs of a cell the last starts at a multiple of step before the anchor.
                        last = anchor - (anchor - first) // step * step
                        end = min(last, span["last"])
                        core = data[last : last - step + 1 + unit.run].tobytes()
                        hull = data[first : end + unit.run].tobytes()
                        digests = [int.from_bytes(hashlib.blake2b(x, digest_size=16).digest(), "little") for x in (core, hull)]
                        halves = [(d >> s & (2**64 - 1)) - (2**64 if d >> s & 2**63 else 0) for d in digests for s in (0, 64)]
                        place = hashlib.blake2b(b"%d %d %d" % (k1[r], k2[r], lo[r] + first), digest_size=8).digest()
                        who = int.from_bytes(place, "little", signed=True)
                        for to, x in zip(out, (*halves, who, k1[r], k2[r], lo[r], first, end, asks[r]), strict=True):
                            to.append(x)
                        first = end + 1
            kinds = [pa.int64()] * 7 + [pa.int32()] * 3 + [pa.bool_()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["c1", "c2", "g1", "g2", "who", "k1", "k2", "lo", "first", "last", "asks"])

    return rows.select("h", "k1", "k2", "lo", "asks", "body", "ranges").mapInArrow(scan, _CELL)


def _leveled(rows: DataFrame, unit: repeats.Unit) -> DataFrame:
    """Resolve the contexts of very frequent anchors, whose groups fit in no one place.

    Runs are taken in cells.  A cell whose shared bytes occur once has no repeated
    run; one whose bytes all occur again has only such; the few between are cut
    into smaller cells, down to single runs.  Keys are aggregated where they are
    and met in joins, so no group is gathered and no run is dropped.
    """
    length = F.octet_length("body") - unit.run
    now = rows.withColumn("ranges", F.array(F.struct(F.lit(0).alias("first"), length.cast("int").alias("last"))))
    done = None
    for step in CELLS:
        cells = staged(_cells(now, unit, step), "cells")
        ends = F.min("who").alias("one"), F.max("who").alias("two")
        cores = staged(cells.groupBy("c1", "c2").agg(*ends).filter("one != two").select("c1", "c2"), "cores")
        hulls = staged(cells.groupBy("g1", "g2").agg(*ends).filter("one != two").select("g1", "g2", "one"), "hulls")
        alive = staged(cells.join(cores, ["c1", "c2"]).join(hulls, ["g1", "g2"], "left").drop("c1", "c2", "g1", "g2"), "alive")
        yes = alive.filter("one IS NOT NULL AND asks").select(
            "k1", "k2", (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last") + unit.run).alias("hi")
        )
        done = yes if done is None else done.unionByName(yes)
        discard(cells, cores, hulls)
        # A settled cell stays once, for others to be held against.
        left = alive.filter("one IS NULL OR one = who").withColumn("asks", F.col("asks") & F.col("one").isNull())
        ranges = left.groupBy("k1", "k2", "lo").agg(F.collect_set(F.struct("first", "last")).alias("ranges"), F.max("asks").alias("asks"))
        now = rows.drop("asks").join(ranges, ["k1", "k2", "lo"])
    return done.distinct()


_SIDE = "h long, side int, part binary, k1 long, k2 long, at int"
_SIDES = ("h", "side", "part", "k1", "k2", "at")


def _sides(rows: DataFrame, unit: repeats.Unit) -> DataFrame:
    """Bytes to either side of each context's anchor, read away from it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            h, k1, k2, lo = (batch.column(i).to_pylist() for i in range(4))
            for r, body in enumerate(batch.column(4)):
                raw = body.as_py()
                at = _anchor_at(np.frombuffer(raw, np.uint8), h[r], unit)
                for side, part in ((0, raw[:at][::-1]), (1, raw[at + unit.anchor :])):
                    for to, x in zip(out, (h[r], side, part, k1[r], k2[r], lo[r] + at), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], list(_SIDES))

    return rows.select("h", "k1", "k2", "lo", "body").mapInArrow(scan, _SIDE)


def _agreed(sides: DataFrame) -> DataFrame:
    """``n``: bytes that each of ``sides``, in order, shares with the one before or after it in its partition.

    In whole steps.  ``edge`` tells the first and the last of a partition.
    """

    def common(one: tuple, two: tuple) -> int:
        if one[:2] != two[:2]:
            return 0
        n, most = 0, min(len(one[2]), len(two[2]))
        while n + STEP <= most and one[2][n : n + STEP] == two[2][n : n + STEP]:
            n += STEP
        return n

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*_SIDES, "n", "edge"])

        held, before, first = None, 0, True
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    after = common(held, row)
                    out.append((*held, max(before, after), first))
                    before, first = after, False
                held = row
            if out:
                yield done(out)
        if held is not None:
            yield done([(*held, before, True)])

    return sides.select(*_SIDES).mapInArrow(scan, f"{_SIDE}, n int, edge boolean")


def _reached(rows: DataFrame, unit: repeats.Unit) -> DataFrame:
    """What contexts of very frequent anchors share with another one, to ``STEP`` bytes.

    Both sides of all contexts are sorted, by ranges: none shares more with another
    than with a neighbour, so there is one row a side and no group is gathered.
    Neighbours in two partitions meet among the edges of partitions.
    """
    sides = staged(_sides(rows.dropDuplicates(["h", "k1", "k2", "lo"]), unit), "sides")
    inner = staged(_agreed(sides.repartitionByRange(*_SIDES).sortWithinPartitions(*_SIDES)), "agreed")
    outer = _agreed(inner.filter("edge").coalesce(1).sortWithinPartitions(*_SIDES))
    reach = inner.unionByName(outer).groupBy("k1", "k2", "at").agg(*(F.coalesce(F.max(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)))
    near = reach.select("k1", "k2", (F.col("at") - F.col("n0")).alias("lo"), (F.col("at") + unit.anchor + F.col("n1")).alias("hi"))
    near = staged(near.filter(F.col("hi") - F.col("lo") >= PASSAGE), "near")
    discard(sides, inner)
    # Longer stretches may be two partners' halves: whether they repeat is decided run by run.
    return near.withColumn("hi", F.least("hi", F.col("lo") + unit.run - 1))


def resolve(source: DataFrame, text: str, unit: repeats.Unit) -> DataFrame:
    """Repeated runs in the contexts of open anchors, and shorter stretches that are shared."""
    rows = staged(contexts(source, text, unit), "contexts")
    many = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("h")
    many = staged(many, "frequent")
    few = staged(_expand(rows.join(many, "h", "left_anti").select(*rows.columns), unit), "expanded")
    if many.isEmpty():
        discard(rows, many)
        return few
    frequent = rows.join(many, "h", "left_semi").select(*rows.columns)
    most = staged(_leveled(frequent, unit), "leveled")
    near = _reached(frequent, unit)
    discard(rows, many)
    return few.unionByName(most).unionByName(near)


def repeated_bytes(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: bytes covered by a repeated string of 400, as [lo, hi) runs.

    A null list means that every byte of a text of 400 bytes or more is covered
    (the text itself is copied).  Spans may overlap and stand in no order;
    :func:`cut` merges them.  Null, empty and shorter texts have none.
    """
    spans = F.filter("spans", lambda x: x["hi"] - x["lo"] >= UNIT.run)
    return repeats.settle(df, text, UNIT, resolve, "spans").select("row.*", spans.alias("spans"))


_CUT = "n_bytes long, n_removed long, n_spans long, longest_shared long, kept binary"
_ADDED = ("n_bytes", "n_removed", "n_spans", "longest_shared", "kept")


def cut(df: DataFrame, text: str = "text", hashed: bool = False) -> DataFrame:
    """Remove repeated bytes: adds ``n_bytes``, ``n_removed``, ``n_spans``, ``longest_shared``, ``kept``.

    ``kept`` is the other bytes one after another: a removed run may split a
    character, so they are binary.  With ``hashed`` it is their SHA-256 in hex and
    the text is not returned.  ``longest_shared`` is the longest removed run, or
    else the longest stretch of ``PASSAGE`` bytes or more that is seen to stand
    elsewhere too: around an anchor of the text, to either side as far as any
    other text agrees, in whole steps of 16 bytes from the anchor, and 399 at most.
    It is 0 if there is none; a passage below 400 bytes without an anchor is not
    seen.

    A null or empty text has no bytes and an empty ``kept``; texts below 400 bytes
    keep all; of texts that are repeated, in rows of their own or as repeated rows,
    each loses every byte.  Columns with the names of those added are replaced; all
    others pass through, whatever they are called.  An empty table gives an empty
    result.
    """
    rows = repeats.settle(df, text, UNIT, resolve, *_ADDED, *([text] if hashed else []))
    kind = _CUT.replace("binary", "string") if hashed else _CUT
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string(kind).fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            whole = spans.is_null().to_numpy(zero_copy_only=False)
            starts = spans.offsets.to_numpy()
            lo, hi = (spans.values.field(x).to_numpy() for x in ("lo", "hi"))
            totals, gone, runs, longest, kept = [], [], [], [], []
            for piece in pieces(batch.column(1)):
                raw = bytes(piece.data)
                for k in range(piece.hi - piece.lo):
                    r = piece.lo + k
                    body = raw[piece.offsets[k] : piece.offsets[k + 1]]
                    n = len(body)
                    if whole[r]:
                        a, b = ([0], [n]) if n >= UNIT.run else ([], [])
                        most = n if n >= PASSAGE else 0
                    else:
                        x, y = lo[starts[r] : starts[r + 1]], hi[starts[r] : starts[r + 1]]
                        long = y - x >= UNIT.run
                        a, b = (z.tolist() for z in repeats.merge(x[long], y[long]))
                        most = max((q - p for p, q in zip(a, b, strict=True)), default=int((y - x).max(initial=0)))
                    left = b"".join(body[x:y] for x, y in zip([0, *b], [*a, n], strict=True))
                    totals.append(n)
                    gone.append(n - len(left))
                    runs.append(len(a))
                    longest.append(most)
                    kept.append(hashlib.sha256(left).hexdigest() if hashed else left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (totals, gone, runs, longest)), pa.array(kept, pa.string() if hashed else pa.binary())],
                names=["row", *_ADDED],
            )

    return rows.mapInArrow(scan, schema).select("row.*", *_ADDED)


def digest(df: DataFrame) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, longest shared stretch, SHA-256 of the rest."""
    return cut(df.select("doc_id", "text"), hashed=True).withColumnRenamed("kept", "kept_sha256")
