"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size.  For a partition of items with up to ``U``
shingles, a document is cut into windows of ``2 * U`` shingles, ``U`` apart, so
that any run of ``U`` lies in one window and an item fills a good part of it:
containment is then a Jaccard similarity that MinHash can see, however long the
document is.  Signatures are one-permutation MinHash (the least hash in each of
``BINS`` bins); one equal bin makes a candidate, and exact shingle containment
in the window decides.  An item of few shingles has few bins to be seen by: up to
``SMALL`` shingles, any of them makes a candidate.

The index holds the items, which are few.  One of up to ``BLOCK_BYTES`` of text is
sent along with a single scan.  More items are taken block by block: each block's
scan writes out which texts contain what, so there is one block at a time on the
driver and in a worker, and only texts with a match meet their matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import content_key, discard, maybe_in, name, staged, unused, whole_row
from .kernels import U64, pieces, run_hash, words

WIDTH = 5
BINS = 64
THRESHOLD = 0.8
#: Bytes of item text in one block of the index; more items make more blocks.
BLOCK_BYTES = 8 << 20
#: Shingles up to which every shingle of an item is looked up.
SMALL = 32
_BUCKET_BITS = 20


@dataclass
class Index:
    """Signatures and shingle sets of a block of items."""

    threshold: float
    ids: list = field(default_factory=list)
    shingle_sets: list[np.ndarray] = field(default_factory=list)
    widths: list[int] = field(default_factory=list)
    limits: list[int] = field(default_factory=list)
    #: Per shingle width: sorted signature values, the item of each, and a filter.
    lookup: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def _signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin that holds one."""
    order = np.lexsort((shingles, shingles % U64(BINS)))
    bins = (shingles % U64(BINS))[order]
    first = np.append(True, bins[1:] != bins[:-1])
    return shingles[order][first]


def _limit(size: int) -> int:
    """Upper size of the partition that ``size`` falls in: 8, 12, 18, 27, ..."""
    top = 8
    while top < size:
        top += top // 2
    return top


def build_index(items: list[tuple], threshold: float = THRESHOLD) -> Index:
    """Index (id, text) items; one without words is not searched for.

    An item of fewer than five words is a single shingle of all its words.
    """
    index = Index(threshold)
    signatures: dict[int, list[tuple[np.ndarray, int]]] = {}
    for piece in pieces(pa.array([t for _, t in items], pa.large_string())):
        w = words(piece, lower=True)
        for k in range(piece.hi - piece.lo):
            own = w.hashes[w.bounds[k] : w.bounds[k + 1]]
            if not len(own):
                continue
            width = min(WIDTH, len(own))
            shingles = np.unique(run_hash(own, width))
            number = len(index.ids)
            index.ids.append(items[piece.lo + k][0])
            index.shingle_sets.append(shingles)
            index.widths.append(width)
            index.limits.append(_limit(len(shingles)))
            signatures.setdefault(width, []).append((shingles if len(shingles) <= SMALL else _signature(shingles), number))
    for width, found in signatures.items():
        values = np.concatenate([s for s, _ in found])
        owners = np.concatenate([np.full(len(s), n) for s, n in found])
        order = np.argsort(values, kind="stable")
        likely = np.zeros(1 << _BUCKET_BITS, bool)
        likely[values >> U64(64 - _BUCKET_BITS)] = True
        index.lookup[width] = (values[order], owners[order], likely)
    return index


def search(index: Index, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, int]]:
    """row -> item number -> most item shingles found in one window."""
    out: dict[int, dict[int, int]] = {}
    for width, (values, owners, likely) in index.lookup.items():
        runs = run_hash(hashes, width)
        spots = np.flatnonzero(likely[runs >> U64(64 - _BUCKET_BITS)])
        if not len(spots):
            continue
        left = np.searchsorted(values, runs[spots], side="left")
        right = np.searchsorted(values, runs[spots], side="right")
        hit = right > left
        seen: set[tuple[int, int, int]] = set()
        for at, a, b in zip(spots[hit].tolist(), left[hit].tolist(), right[hit].tolist(), strict=True):
            row = int(np.searchsorted(bounds, at, side="right")) - 1
            begin, end = int(bounds[row]), int(bounds[row + 1]) - width + 1
            if at >= end:  # the run crosses into the next row
                continue
            for item in owners[a:b].tolist():
                step = index.limits[item]
                for window in {max(0, (at - begin) // step - 1), (at - begin) // step}:
                    if (row, item, window) in seen:
                        continue
                    inside = runs[begin + window * step : min(begin + (window + 2) * step, end)]
                    shingles = index.shingle_sets[item]
                    if len(shingles) > SMALL:
                        same = inside[inside % U64(BINS) == runs[at] % U64(BINS)]
                        if same.min() != runs[at]:  # another shingle is least: this bin differs
                            continue
                    seen.add((row, item, window))
                    shared = int(np.isin(shingles, inside).sum())
                    if shared >= index.threshold * len(shingles):
                        best = out.setdefault(row, {})
                        best[item] = max(best.get(item, 0), shared)
    return out


_MATCH = "array<struct<item_id:long,shared:long,size:long>>"
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("shared", pa.int64()), ("size", pa.int64())]))


def _blocks(items: DataFrame, item_id: str, text: str) -> tuple[int, Callable[[int], list[tuple]]]:
    """How many blocks of ``BLOCK_BYTES`` the items make, and a way to get one."""
    rows = items.select(name(item_id).cast("long").alias("id"), F.coalesce(name(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 + total // BLOCK_BYTES

    def block(k: int) -> list[tuple]:
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else rows
        return sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))

    return count, block


def _matches(index: Index, texts: pa.Array) -> pa.Array:
    """Items found in each text."""
    rows: list[list] = [[] for _ in range(len(texts))]
    for piece in pieces(texts):
        w = words(piece, lower=True)
        for row, best in search(index, w.hashes, w.bounds).items():
            rows[piece.lo + row] = [{"item_id": index.ids[i], "shared": n, "size": len(index.shingle_sets[i])} for i, n in sorted(best.items())]
    return pa.array(rows, _MATCH_ARROW)


def _by_text(df: DataFrame, text: str, index: Index) -> DataFrame:
    """(``k1``, ``k2``, ``found``) of texts that contain an item, known by their content."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matches(index, batch.column(2))
            some = pc.greater(pc.list_value_length(found), 0)
            yield pa.record_batch([x.filter(some) for x in (batch.column(0), batch.column(1), found)], ["k1", "k2", "found"])

    return df.select(*content_key(name(text)), name(text).alias("text")).mapInArrow(scan, f"k1 long, k2 long, found {_MATCH}")


def find_items(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "matches",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Add the array ``out`` of items contained in each text.

    An item is contained if a window of the text (see the module) holds at least
    ``threshold`` of its distinct shingles of five words; words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  ``shared`` is the most that one
    window holds, ``size`` how many the item has.

    Null and empty texts, and texts shorter than a shingle, contain nothing; an
    empty or null item is not searched for; items with one id are searched for one
    by one and reported by the best of them; repeated rows are searched one by
    one.  A column called ``out`` is replaced.
    """
    count, block = _blocks(items, item_id, item_text)
    rows = df.select(whole_row(df, out).alias("row"), *content_key(name(text)), name(text).alias("text"))
    if count == 1:
        index = build_index(block(0), threshold)
        at = [c.lower() for c in rows.schema["row"].dataType.names].index(text.lower())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column(0), _matches(index, batch.column(0).field(at))], ["row", "found"])

        schema = T.StructType([rows.schema["row"], T.StructField("found", T._parse_datatype_string(_MATCH))])
        found = rows.select("row").mapInArrow(scan, schema)
    else:
        parts = [staged(_by_text(df, text, build_index(block(k), threshold)), "matches") for k in range(count)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        every = staged(every.dropDuplicates(["k1", "k2", "found"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list("found")).alias("found")), "matches")
        discard(*parts)
        none = F.array().cast(_MATCH)
        met = maybe_in(rows, ["k1", "k2"], every).join(every, ["k1", "k2"], "left").select("row", F.coalesce("found", none).alias("found"))
        found = met.unionByName(maybe_in(rows, ["k1", "k2"], every, within=False).select("row", none.alias("found")))
    return found.select("row.*", F.col("found").alias(out))


def remove_contaminated(df: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``df`` that contain no item, with the columns of ``df``.

    Null and empty texts stay; without items all rows stay; repeated rows all stay
    or all go.
    """
    mark = unused("matches", df)
    return find_items(df, items, text, out=mark).filter(F.size(mark) == 0).select(*(name(c) for c in df.columns))


def digest(df: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and item that it contains."""
    found = find_items(df.select("doc_id", "text"), items)
    # The array is read once per row: only documents with a match are exploded.
    pairs = found.filter(F.size("matches") > 0).select("doc_id", F.explode("matches").alias("m"))
    return (
        pairs.groupBy("doc_id", F.col("m.item_id").alias("item_id"))
        .agg(F.max(F.struct(F.col("m.shared") / F.col("m.size"), "m.shared", "m.size")).alias("m"))
        .select("doc_id", "item_id", F.col("m.shared").alias("shared"), F.col("m.size").alias("item_shingles"), (F.col("m.shared") / F.col("m.size")).alias("containment"))
    )
