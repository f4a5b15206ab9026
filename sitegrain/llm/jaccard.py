"""N-gram Jaccard join as a blocked sparse matrix product.

A document is a row of a sparse 0/1 matrix over hashed shingles, and overlaps
are entries of that matrix times its transpose.  Multiplying everything would
touch every pair, so the product is cut into blocks:

1. Documents with equal sets are one row (a class).  A set that links with another
   has all but ``1 - t`` of its shingles in some other set, so sets that have fewer
   are out: told by a fixed part of all shingles, then, for the sets left, by a
   larger one.  The lone shingles of unlike texts are most of the matrix, and go here.
2. Two sets of similarity ``t`` differ in at most ``(1 - t) / (1 + t)`` of their
   joint size.  Shingles are dealt by hash into one part more than that (and a
   few to make up for empty parts), so linked sets agree in a whole part that is
   not empty.  Classes that agree in a part are candidates; their connected
   groups are the diagonal blocks, and no link leaves a block.
3. A block is multiplied in pieces of ``TILE`` rows.  Tiles and pairs whose sizes
   alone rule out ``t`` are skipped.  Large blocks are screened first: the counts
   of a set's shingles by the low bits of their hashes differ by no more than the
   sets do, so pairs over the bound are discarded by 256 bytes a set, and what
   still hangs together are smaller blocks.
4. Then overlap counts are accumulated over shared shingles, and pairs over the
   bound are links.

Connected components of the links follow.  Everything is exact up to 64-bit
hashes of shingles and 128-bit hashes of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, maybe_in, name, staged, unused
from .kernels import U64, mix, pieces, shingles, words

#: Rows of a tile of the product.
TILE = 256
#: Rows from which a block is screened before its texts are multiplied.
SCREENED = 16
#: Sizes that share a number of parts grow by this factor.
_GROWTH = 1.5


def parts_of(size: int, threshold: float) -> list[tuple[int, int, int]]:
    """(class, parts, spare parts) under which a set of ``size`` is dealt.

    A set is dealt under its own class of sizes, and under the next if a larger
    partner can be there.
    """
    out = []
    level = 0 if size <= 1 else int(math.floor(math.log(size) / math.log(_GROWTH)))
    while _GROWTH**level > size:
        level -= 1
    while _GROWTH ** (level + 1) <= size:
        level += 1
    for c in (level, level + 1):
        if c > level and size < threshold * _GROWTH**c - 1e-9:
            continue
        largest = math.ceil(_GROWTH ** (c + 1))
        differ = int(math.floor(2 * largest * (1 - threshold) / (1 + threshold) + 1e-9))
        # Empty parts to expect of the smallest set dealt under the class, with
        # room for luck; the same for every set of it, or parts would not compare.
        empty = (differ + 1) * math.exp(-max(threshold * _GROWTH**c, 1) / (differ + 1))
        spare = 1 + math.ceil(empty + 3 * math.sqrt(empty))
        out.append((c, differ + 1 + spare, spare))
    return out


def signatures(own: np.ndarray, threshold: float) -> np.ndarray:
    """Hashes of the parts of a set, by which linked sets are bound to meet."""
    size = len(own)
    found = []
    for c, count, spare in parts_of(size, threshold):
        # A shingle's part is the high bits of its hash, scaled: no division bias.
        part = ((mix(own ^ U64(0xA5A5 + c)) >> U64(32)) * U64(count)) >> U64(32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sums = np.add.reduceat(mix(own[order] + U64(c)), first)
        sizes = np.diff(np.append(first, size)).astype(U64)
        found.append(mix(sums + mix(part[first] * U64(0x10001) + U64(c)) + sizes))
        if count - len(first) > spare:
            # Too many empty parts to be sure of one that is not: such sets also
            # meet by the least of their shingles (prefix filtering).
            need = size - math.ceil(threshold * size) + 1
            least = np.sort(own)[:need]
            found.append(mix(least ^ U64(0x5EED)))
    return np.unique(np.concatenate(found))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text with words.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words
    than ``width`` has one shingle, all its words.
    """
    for piece in pieces(column):
        w = words(piece, lower=True)
        runs = shingles(w.hashes, width)
        for k in range(piece.hi - piece.lo):
            a, b = int(w.bounds[k]), int(w.bounds[k + 1])
            if b - a >= width:
                yield piece.lo + k, np.unique(runs[a : b - width + 1])
            elif b > a:
                yield piece.lo + k, mix(shingles(w.hashes[a:b], b - a, salt=b - a) + U64(b - a))


def set_hash(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    return tuple(int(np.add.reduce(mix(x)).view(np.int64)) for x in (own, own ^ U64(0xC0FFEE)))


def _sets(df: DataFrame, text: str, rid: str, width: int) -> DataFrame:
    """Size and 128-bit hash of each set that is not empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = [(row, len(own), *set_hash(own)) for row, own in shingle_sets(batch.column(1), width)]
            rows, *facts = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (ids[list(rows)], *facts)], ["rid", "n_shingles", "s1", "s2"])

    return df.select(F.col(rid).alias("rid"), F.col(text)).mapInArrow(scan, "rid long, n_shingles long, s1 long, s2 long")


#: Bits of the map of hashes that two sets have: 16 MB, however many there are.
_MAP_BITS = 1 << 27
_MAP_WORD = 1 << 15
_ROWS = "x long, s1 long, need int"


def _map_of(shared: DataFrame) -> np.ndarray:
    """Which values modulo ``_MAP_BITS`` the column ``x`` has, one bit each.

    At most ``_MAP_BITS / 8`` bytes come to the driver.  Where more hashes are
    shared than the map can tell apart it lets through more, never less.
    """
    bit = F.pmod("x", F.lit(_MAP_BITS))
    words = shared.groupBy(F.floor(bit / _MAP_WORD).alias("word")).agg(F.bitmap_construct_agg(bit % _MAP_WORD).alias("bits"))
    out = np.zeros((_MAP_BITS // _MAP_WORD, _MAP_WORD // 8), np.uint8)
    for row in words.toLocalIterator():
        out[row["word"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _matrix(df: DataFrame, text: str, width: int, hashes, only=None) -> DataFrame:
    """(``x``, ``s1``, ``need``): hashes of each set, once per set and task.

    ``hashes`` gives those of a sorted set, and of how many another set must have
    them too.  ``only`` is a broadcast map of the hashes that other sets have; a
    set that cannot reach its need by it has no rows, one that needs none has one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        wanted = None if only is None else only.value
        for batch in batches:
            found, owners, needs = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for _, own in shingle_sets(batch.column(0), width):
                s1 = set_hash(own)[0]
                if s1 in seen:
                    continue
                seen.add(s1)
                x, need = hashes(own)
                if wanted is not None:
                    bit = x & U64(_MAP_BITS - 1)
                    x = x[(wanted[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1]
                    if len(x) < need:
                        continue
                    if not need:
                        x = np.append(x, np.array([s1]).view(U64))
                found.append(x)
                owners.append(np.full(len(x), s1))
                needs.append(np.full(len(x), need, np.int32))
            yield pa.record_batch([np.concatenate(found).view(np.int64), np.concatenate(owners), np.concatenate(needs)], ["x", "s1", "need"])

    return df.select(text).mapInArrow(scan, _ROWS)


def _met(df: DataFrame, text: str, width: int, hashes) -> tuple[DataFrame, DataFrame]:
    """Rows of the matrix that may have a hash in common, and the hashes that do.

    The rows are shuffled, never stored: a first pass counts which hashes two sets
    have, a second takes these alone to the sets.  The second result is a staged
    table (``x``, ``least``).
    """
    shared = _matrix(df, text, width, hashes).groupBy("x").agg(F.min("s1").alias("least"), F.max("s1").alias("most"))
    shared = staged(shared.filter("least != most").select("x", "least"), "shared")
    only = df.sparkSession.sparkContext.broadcast(_map_of(shared))
    return _matrix(df, text, width, hashes, only), shared


def spread(own: np.ndarray, share: float, threshold: float) -> tuple[np.ndarray, int]:
    """The part of a set that falls in ``share`` of all hashes, and of how many of
    it another set must have them for a link: all but those that may differ."""
    inside = own if share >= 1 else own[mix(own ^ U64(0x51CE)) < U64(int(share * 2.0**64))]
    differ = len(own) - math.ceil(threshold * len(own) - 1e-9)
    return inside, max(len(inside) - differ, 0)


def shares_of(threshold: float) -> tuple[float, float]:
    """Parts of all shingles by which sets are told to share too little.

    A first one of half as many again as may differ; then twice that, for the sets
    left, or all shingles where that is most of them.
    """
    differ = 1 - threshold
    return 1.5 * differ, 3 * differ if 3 * differ < 0.5 else 1.0


def _shared_enough(df: DataFrame, text: str, width: int, threshold: float, share: float) -> DataFrame:
    """``s1`` of the sets that have enough shingles with others; a staged table."""
    rows, shared = _met(df, text, width, lambda own: spread(own, share, threshold))
    held = rows.join(shared.select("x", F.lit(1).alias("one")), "x", "left").groupBy("s1").agg(F.count("one").alias("n"), F.max("need").alias("need"))
    out = staged(held.filter("n >= need").select("s1"), "enough")
    discard(shared)
    return out


def _bins(texts: DataFrame, width: int) -> DataFrame:
    """(``node``, ``bins``): counts of a set's shingles by the low bits of their hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            rows, found = [], []
            for row, own in shingle_sets(batch.column(1), width):
                rows.append(row)
                found.append(np.minimum(np.bincount((own & U64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
            yield pa.record_batch([pa.array(nodes[rows], pa.int64()), pa.array(found, pa.binary())], ["node", "bins"])

    return texts.select("node", "text").mapInArrow(scan, "node long, bins binary")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected (a, b) edges: the smallest node reachable.

    Each round every node takes the least label around it, then that label's own
    label (pointer jumping), so the number of rounds grows with the logarithm of
    the longest path.  Labels stay distributed and every round is a written table.
    Neighbours' labels are aggregated before they meet, so a hub is no hot spot.
    """
    own = staged(edges.select("a", "b"), "edges")
    both = staged(own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", "label", F.least("label", "near").alias("new"))
        # The label's own label, looked up by the label: many nodes share one, so
        # distinct labels are looked up once.
        heads = nearer.select(F.col("node").alias("head"), F.col("new").alias("jump"))
        jumped = nearer.join(heads, nearer["new"] == heads["head"], "left").select(
            "node", F.least("new", F.coalesce("jump", "new")).alias("label"), F.col("label").alias("old")
        )
        jumped = staged(jumped, "labels")
        discard(held)
        held, labels = jumped, jumped.select("node", "label")
        if not jumped.filter(F.col("label") != F.col("old")).limit(1).collect():
            break
    else:
        raise RuntimeError("components did not settle")
    discard(both, own)
    return labels.withColumnRenamed("label", "component")


def product(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows whose Jaccard similarity reaches ``threshold``.

    Overlaps are the entries of left times right transposed (or of left times
    itself, above the diagonal), accumulated shingle by shingle: the columns of
    both are sorted together, and runs of equal ones give the products.
    """
    other = left if right is None else right
    sizes_l, sizes_r = (np.array([len(x) for x in s], np.int64) for s in (left, other))
    values = np.concatenate([*other])
    owner = np.repeat(np.arange(len(other)), sizes_r)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    pairs_i, pairs_j = [], []
    for i, own in enumerate(left):
        a = np.searchsorted(values, own, side="left")
        b = np.searchsorted(values, own, side="right")
        n = b - a
        at = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
        shared = np.bincount(owner[at], minlength=len(other))
        # 100 * intersection >= 90 * union, for threshold 0.9, in whole numbers.
        union = sizes_l[i] + sizes_r - shared
        linked = 1_000_000 * shared >= round(1_000_000 * threshold) * union
        if right is None:
            linked[: i + 1] = False
        hits = np.flatnonzero(linked)
        pairs_i.append(np.full(len(hits), i))
        pairs_j.append(hits)
    return np.concatenate(pairs_i), np.concatenate(pairs_j)


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """As few links as connect what the given ones do: a tree per group."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        s, t = top(x), top(y)
        if s != t:
            up[s] = t
            out.append((x, y))
    return out


def alike(left: np.ndarray, right: np.ndarray, sizes_l: np.ndarray, sizes_r: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that counts by hash bin do not rule out."""
    pairs_i, pairs_j = [], []
    share = (1 - threshold) / (1 + threshold)
    for i, own in enumerate(left):
        apart = np.abs(right - own).sum(axis=1)
        hits = np.flatnonzero(apart <= (sizes_l[i] + sizes_r) * share + 1e-6)
        pairs_i.append(np.full(len(hits), i))
        pairs_j.append(hits)
    return np.concatenate(pairs_i), np.concatenate(pairs_j)


def _tiled(blocks: DataFrame, facts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Work groups of the product: (node, block, n_shingles) with ``facts`` by node.

    The second result is a staged table that the first reads.

    A block's rows are ordered by size and cut into tiles; a pair of tiles meets
    only if its sizes allow a link, and each such pair is one group.  Blocks of one
    tile are packed, some hundred rows to a group.
    """
    from pyspark.sql import Window

    # Place of each row in its block by size, without a window over the block:
    # sizes are counted first, and rows of one size are dealt to tiles by hash.
    sizes = blocks.groupBy("block", "n_shingles").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("block").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("block", "n_shingles", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    placed = blocks.join(before, ["block", "n_shingles"]).select(
        "node", "block", "n_shingles",
        F.floor((F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))) / TILE).alias("tile"),
    )
    placed = staged(placed, "tiles")
    tiles = placed.groupBy("block", "tile").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    many = tiles.groupBy("block").agg((F.count(F.lit(1)) > 1).alias("many"))
    one, two = tiles.alias("one"), tiles.alias("two")
    meets = (
        one.join(two, "block")
        .filter((F.col("one.tile") <= F.col("two.tile")) & (F.col("two.least") * threshold <= F.col("one.most") + 1e-9))
        .select("block", F.col("one.tile").alias("t1"), F.col("two.tile").alias("t2"))
    )
    work = meets.select("block", F.col("t1").alias("tile"), "t1", "t2", F.lit(0).alias("side")).unionByName(
        meets.filter("t1 != t2").select("block", F.col("t2").alias("tile"), "t1", "t2", F.lit(1).alias("side"))
    )
    packs = 1 + placed.count() // TILE
    pack = F.when(F.col("many"), F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(packs)))
    rows = (
        placed.join(work.join(many, "block"), ["block", "tile"])
        .withColumn("pack", pack)
        .join(facts, "node")
        .select("many", "pack", "t1", "t2", "side", "block", "node", "n_shingles", *[c for c in facts.columns if c != "node"])
    )
    return rows, placed


def _connected(blocks: DataFrame, facts: DataFrame, threshold: float, pairs) -> DataFrame:
    """Components of what ``pairs`` finds in each block of each work group."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        # One row per node and side: a repeated row brings its node again.
        rows = rows.drop_duplicates(["block", "side", "node"]).sort_values(["block", "side", "node"])
        for i, j in pairs(rows):
            found += forest(i, j)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    rows, tiles = _tiled(blocks, facts, threshold)
    found = components(rows.groupBy("many", "pack", "t1", "t2").applyInPandas(group, "a long, b long"))
    discard(tiles)
    return found


def _sides(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places of each block's rows, and of its other side if it has one."""
    block, side = rows["block"].to_numpy(), rows["side"].to_numpy()
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() + [len(block)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = np.arange(a, b)
        other = at[side[a:b] == 1]
        yield at[side[a:b] == 0], other if len(other) else None


def _screen(blocks: DataFrame, bins: DataFrame, threshold: float) -> DataFrame:
    def pairs(rows: pd.DataFrame):
        table = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, 256).astype(np.int16)
        sizes, nodes = rows["n_shingles"].to_numpy(), rows["node"].to_numpy()
        for one, two in _sides(rows):
            two = one if two is None else two
            i, j = alike(table[one], table[two], sizes[one], sizes[two], threshold)
            yield nodes[one][i].tolist(), nodes[two][j].tolist()

    return _connected(blocks, bins, threshold, pairs)


def _links(blocks: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    def pairs(rows: pd.DataFrame):
        sets = dict(shingle_sets(pa.array(rows["text"], pa.large_string()), width))
        nodes = rows["node"].to_numpy()
        for one, two in _sides(rows):
            i, j = product([sets[k] for k in one], None if two is None else [sets[k] for k in two], threshold)
            yield nodes[one][i].tolist(), nodes[one if two is None else two][j].tolist()

    return _connected(blocks, texts, threshold, pairs)


def _multiplied(df: DataFrame, text: str, rid: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets, blocks of class representatives to multiply, and texts with theirs among them.

    All three are staged tables.
    """
    df = df.filter(name(rid).isNotNull()).select(name(rid).alias("node"), F.coalesce(name(text), F.lit("")).alias("text"))
    sets = staged(_sets(df, "text", "node", width), "sets")
    classes = sets.groupBy("s1", "s2", "n_shingles").agg(F.min("rid").alias("node"))
    # Sets are told apart by half of their hash until blocks are known: two sets
    # that agree in it would share a block, no more.
    texts = df
    for share in shares_of(threshold):
        enough = _shared_enough(texts, "text", width, threshold, share)
        before, texts = texts, staged(_texts_of(texts, classes.join(enough, "s1", "left_semi")), "enough")
        discard(before, enough)
    rows, shared = _met(texts, "text", width, lambda own: (signatures(own, threshold), 1))
    near = rows.join(shared, "x").filter(F.col("s1") != F.col("least"))
    near = staged(near.select(F.col("least").alias("a"), F.col("s1").alias("b")).distinct(), "near")
    discard(shared)
    blocks = components(near)
    discard(near)
    members = staged(classes.join(blocks.select(F.col("node").alias("s1"), F.col("component").alias("block")), "s1").select("node", "n_shingles", "block"), "members")
    counted = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    large = staged(members.join(counted.filter(F.col("n") >= SCREENED).select("block"), "block", "left_semi"), "large")
    small = members.join(counted.filter(F.col("n") < SCREENED).select("block"), "block", "left_semi")
    bins = staged(_bins(_texts_of(texts, large), width), "bins")
    smaller = _screen(large, bins, threshold).withColumnRenamed("component", "block")
    discard(bins)
    screened = large.select("node", "n_shingles").join(smaller, "node")
    blocks = staged(small.select("node", "n_shingles", "block").unionByName(screened.select("node", "n_shingles", "block")), "blocks")
    discard(members, large)
    return sets, blocks, texts


def _texts_of(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``df`` (``node``, ``text``) whose node is a member."""
    return maybe_in(df, ["node"], members).join(members.select("node").distinct(), "node", "left_semi")


def linked(df: DataFrame, text: str = "text", rid: str = "doc_id", width: int = 3, threshold: float = 0.9) -> DataFrame:
    """(rid, n_shingles, component_id) of every row.

    Two rows link when their sets of shingles reach the similarity ``threshold``;
    ``component_id`` is the smallest ``rid`` reachable by links, itself included.
    A text without words, empty or null, has 0 shingles and links with nothing.
    Rows with equal sets link with each other.  A null ``rid`` takes no part: its
    component is null.  Repeated rows are one node and each gets its row; should
    texts that differ share a ``rid``, both rows have the larger size and the
    smaller component.
    """
    sets, blocks, texts = _multiplied(df, text, rid, width, threshold)
    found = _links(blocks, texts, width, threshold)
    discard(blocks, texts)
    classes = sets.groupBy("s1", "s2", "n_shingles").agg(F.min("rid").alias("node"))
    of = classes.join(found, "node", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    known = sets.select("rid", "n_shingles", "s1", "s2").join(of, ["s1", "s2", "n_shingles"])
    known = known.groupBy("rid").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    every = df.select(name(rid).alias("rid"))
    return every.join(known, "rid", "left").select(
        F.col("rid").alias(rid), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "rid").alias("component_id")
    )


def links(df: DataFrame, text: str = "text", rid: str = "doc_id", width: int = 3, threshold: float = 0.9) -> DataFrame:
    """(a, b, shared, size_a, size_b, copies_a, copies_b) of every link.

    ``a`` < ``b`` stand for their classes: the smallest ``rid`` with the set, which
    ``copies`` rids have; ``shared`` is the overlap.  A class of several copies
    links with itself, a row in which ``a`` is ``b``.  Rows that link are those of
    :func:`linked`; a ``rid`` is taken to have one text.
    """
    sets, members, texts = _multiplied(df, text, rid, width, threshold)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        rows = rows.drop_duplicates(["block", "side", "node"]).sort_values(["block", "side", "node"])
        held = dict(shingle_sets(pa.array(rows["text"], pa.large_string()), width))
        nodes = rows["node"].tolist()
        for one, two in _sides(rows):
            other = one if two is None else two
            i, j = product([held[k] for k in one], None if two is None else [held[k] for k in two], threshold)
            for x, y in zip(one[i].tolist(), other[j].tolist(), strict=True):
                shared = len(np.intersect1d(held[x], held[y], assume_unique=True))
                found.append((*sorted((nodes[x], nodes[y])), shared))
        return pd.DataFrame(found, columns=["a", "b", "shared"], dtype="int64")

    sizes = sets.groupBy("s1", "s2", "n_shingles").agg(F.min("rid").alias("node"), F.countDistinct("rid").alias("copies"))
    sizes = staged(sizes.select("node", "n_shingles", "copies"), "copies")
    work, _ = _tiled(members, texts, threshold)
    pairs = work.groupBy("many", "pack", "t1", "t2").applyInPandas(group, "a long, b long, shared long").distinct()
    for side in "ab":
        of = sizes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("copies").alias(f"copies_{side}"))
        pairs = pairs.join(of, side)
    own = sizes.filter("copies > 1").selectExpr(
        "node AS a", "node AS b", "n_shingles AS shared", "n_shingles AS size_a", "n_shingles AS size_b", "copies AS copies_a", "copies AS copies_b"
    )
    return pairs.select(own.columns).unionByName(own)


def digest(df: DataFrame) -> DataFrame:
    """One row per document: set size and component."""
    return linked(df.select("doc_id", "text"))


def one_of_each(df: DataFrame, text: str = "text", rid: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``df`` but for near-duplicates: the smallest ``rid`` of a component stays.

    Texts without words, null ids and components of one stay; of rows that are
    repeated with their id, all stay or all go.
    """
    found = linked(df, text, rid, width, threshold).select(name(rid).alias("rid"), "component_id")
    gone = staged(found.filter(F.col("rid").isNotNull() & (F.col("component_id") != F.col("rid"))).select("rid").distinct(), "gone")
    mark = unused("rid", df)
    rows = df.select("*", name(rid).alias(mark))
    known = gone.select(F.col("rid").alias(mark))
    # Most rows are told to stay by a hash of their id; the others have to meet it.
    sure = maybe_in(rows, [mark], known, within=False)
    return sure.unionByName(maybe_in(rows, [mark], known).join(known, mark, "left_anti")).select(*(name(c) for c in df.columns))
