"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to (their membership
pattern).  A small network routes the token capacity of each pattern to the
quotas of its sources; using a pattern's tokens a further time costs more, so
the cost of repetition is convex.  The flow says how many tokens each pattern
gives; whole passes take every document, and of the one that is not whole
documents are selected by a seeded hash.  What the selection comes to is a few
ranges of the hash per pattern, so rows are never moved.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, name, staged, unused, whole_row, word_count

#: Patterns up to which their facts are broadcast (some 100 bytes each).
BROADCAST_PATTERNS = 50_000
WEIGHTS = (5, 2, 1)


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; nobody gets over ``cap`` times its size.

    What is over is shared again by weight among the rest until none is above.
    """
    targets = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), total
    while free:
        by = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / by > cap * sizes[k]]
        if not over:
            for k in free:
                targets[k] = left * weights[k] / by
            break
        for k in over:
            targets[k] = float(cap * sizes[k])
        left -= sum(targets[k] for k in over)
        gone = set(over)
        free = [k for k in free if k not in gone]
    return targets


def min_cost_flow(
    capacity: Mapping[str, int], member: Mapping[str, Sequence[int]], quota: Sequence[int], passes: int
) -> dict[str, list[int]]:
    """Tokens that each pattern gives in each pass, at least total cost.

    ``capacity`` has the tokens of each pattern, ``member`` its sources.  A token
    of pass ``k`` costs ``k``, so no pattern is repeated before others that serve
    the same quota are used up.  Successive shortest paths; the network has a
    node per pattern and per source.
    """
    names = sorted(capacity)
    n, m = len(names), len(quota)
    # Nodes: 0 start, 1..n patterns, n+1..n+m sources, n+m+1 end.
    end = n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, c: int, w: int) -> int:
        for x, y, r, z in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(z)
        return len(to) - 2

    first = {p: [edge(0, 1 + k, capacity[p], j) for j in range(passes)] for k, p in enumerate(names)}
    for k, p in enumerate(names):
        for s in member[p]:
            edge(1 + k, n + 1 + s, passes * capacity[p], 0)
    for s in range(m):
        edge(n + 1 + s, end, quota[s], 0)
    height = [0] * (end + 1)
    while True:
        far, via = [float("inf")] * (end + 1), [-1] * (end + 1)
        far[0] = 0
        heap = [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                b = to[e]
                if room[e] and (x := d + cost[e] + height[a] - height[b]) < far[b]:
                    far[b], via[b] = x, e
                    heapq.heappush(heap, (x, b))
        if via[end] < 0:
            break
        height = [h + (f if f < float("inf") else 0) for h, f in zip(height, far, strict=True)]
        path, a = [], end
        while a:
            path.append(via[a])
            a = to[via[a] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {p: [room[e ^ 1] for e in edges] for p, edges in first.items()}


def separate(member: Mapping[str, Sequence[int]], sources: int) -> list[tuple[list[str], list[int]]]:
    """(patterns, sources) that share a source directly or through others.

    Nothing flows between such parts, so each is a network of its own.
    """
    up = list(range(sources))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for of in member.values():
        for s in of[1:]:
            up[top(s)] = top(of[0])
    parts: dict[int, tuple[list[str], list[int]]] = {top(s): ([], []) for s in range(sources)}
    for s in range(sources):
        parts[top(s)][1].append(s)
    for p, of in member.items():
        parts[top(of[0])][0].append(p)
    return list(parts.values())


def _ranges(slim: DataFrame, need: Mapping[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """(least hash, most hash, most size) of the documents that fill each need.

    In order of their hash, documents are taken while they fit.  Those after the
    one that did not, and no larger than what is left, are tried next, until none
    is.  Every round moves on in the hash, and what is left shrinks below the
    document that did not fit.  Cells of the hash tell where a need ends;
    documents are looked at one by one in that cell alone.
    """
    spark = slim.sparkSession
    found: dict[str, list[tuple[int, int, int]]] = {p: [] for p in need}
    open_ = {p: (-(1 << 63), v) for p, v in need.items() if v > 0}
    while open_:
        table = spark.createDataFrame([(p, lo, left) for p, (lo, left) in open_.items()], "pattern string, lo long, left long")
        small = F.broadcast if len(need) <= BROADCAST_PATTERNS else lambda t: t
        fits = slim.join(small(table), "pattern").filter("h >= lo AND size > 0 AND size <= left").withColumn("cell", F.shiftright("h", 52))
        sums = fits.groupBy("pattern", "cell", "left").agg(F.sum("size").alias("held"), F.max("h").alias("last"))
        sums = sums.withColumn("run", F.sum("held").over(Window.partitionBy("pattern").orderBy("cell")))
        whole = F.col("run") <= F.col("left")
        ends = sums.groupBy("pattern", "left").agg(
            F.max(F.when(whole, F.col("last"))).alias("last"),
            F.coalesce(F.max(F.when(whole, F.col("run"))), F.lit(0)).alias("base"),
            F.min(F.when(~whole, F.col("cell"))).alias("cell"),
        ).collect()
        edges = spark.createDataFrame([(r["pattern"], r["cell"], r["base"]) for r in ends if r["cell"] is not None], "pattern string, cell long, base long")
        inside = fits.join(small(edges), ["pattern", "cell"])
        # Equal hashes (repeated rows) count together, so they are taken together.
        inside = inside.withColumn("run", F.col("base") + F.sum("size").over(Window.partitionBy("pattern").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        whole = F.col("run") <= F.col("left")
        last = {
            r["pattern"]: r
            for r in inside.groupBy("pattern").agg(F.max(F.when(whole, F.col("h"))).alias("last"), F.max(F.when(whole, F.col("run"))).alias("run"), F.min("h").alias("first")).collect()
        }
        after = {}
        for r in ends:
            p = r["pattern"]
            lo, left = open_[p]
            edge = last.get(p)
            hi, taken = (edge["last"], edge["run"]) if edge and edge["last"] is not None else (r["last"], r["base"])
            if hi is not None:
                found[p].append((lo, hi, left))
            else:
                hi = edge["first"]  # copies that fit one by one, but not together
            if edge and left > taken and hi < (1 << 63) - 1:
                after[p] = (hi + 1, left - taken)
        open_ = after
    return found


def mix(
    df: DataFrame,
    size: str | Column,
    sources: str = "source",
    weights: Sequence[int] = WEIGHTS,
    scale: float = 1.5,
    passes: int = 2,
    seed: int = 23,
) -> DataFrame:
    """Add ``copies``, ``taken``, ``source_size`` and ``target`` to every row.

    ``size`` is a column, by its name or as an expression.  ``sources`` holds a
    string, or an array of strings where a document belongs to several; null (or
    no) sources make a source of their own, last in order.  Sources in code point
    order have the ``weights`` in turn and share ``scale`` times all sizes, none
    above ``passes`` times its own size.  ``copies`` is how often the mix takes a
    document (0 to ``passes``) and ``taken`` is ``copies`` times its size.  For a
    document of several sources, ``source_size`` and ``target`` are the sums over
    them.

    Null sizes count as 0; rows of size 0 are taken 0 times or more at no
    effect; repeated rows are taken equally often.  An empty table gives an empty
    result.  Other columns pass through, whatever they are called; those with the
    names of the added ones are replaced.  The driver holds a few numbers per
    membership pattern.
    """
    own = ("copies", "taken", "source_size", "target")
    many = isinstance(df.schema[sources].dataType, T.ArrayType)
    col = name(sources)
    listed = F.sort_array(F.array_distinct(F.coalesce(col, F.array()))) if many else F.when(col.isNull(), F.array()).otherwise(F.array(col))
    pattern = F.to_json(F.when(F.size(listed) == 0, F.array(F.lit(None).cast("string"))).otherwise(listed), {"ignoreNullFields": "false"})
    row = whole_row(df, *own)
    rows = df.select(
        row.alias("row"),
        F.coalesce(name(size) if isinstance(size, str) else size, F.lit(0)).cast("long").alias("size"),
        pattern.alias("pattern"),
        F.xxhash64(F.lit(seed), row).alias("h"),
    )
    slim = staged(rows.select("pattern", "size", "h"), "mix")
    held = {r["pattern"]: r["held"] for r in slim.groupBy("pattern").agg(F.sum("size").alias("held")).collect()}
    lists = {p: json.loads(p) for p in held}
    order = sorted({s for x in lists.values() for s in x}, key=lambda s: (s is None, s or ""))
    at = {s: k for k, s in enumerate(order)}
    member = {p: [at[s] for s in x] for p, x in lists.items()}
    sizes = [0] * len(order)
    for p, v in held.items():
        for s in member[p]:
            sizes[s] += v
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(order))], scale * sum(held.values()), passes)
    flow: dict[str, int] = {}
    for patterns, of in separate(member, len(order)):
        local = {s: k for k, s in enumerate(of)}
        routed = min_cost_flow(
            {p: held[p] for p in patterns}, {p: [local[s] for s in member[p]] for p in patterns}, [round(targets[s]) for s in of], passes
        )
        flow |= {p: sum(x) for p, x in routed.items()}
    base = {p: flow[p] // held[p] if held[p] else 0 for p in held}
    ranges = _ranges(slim, {p: flow[p] - base[p] * held[p] for p in held})
    facts = [(p, base[p], ranges[p], sum(sizes[s] for s in member[p]), float(sum(targets[s] for s in member[p]))) for p in held]
    table = df.sparkSession.createDataFrame(
        facts, "pattern string, base int, ranges array<struct<lo:long,hi:long,most:long>>, source_size long, target double"
    )
    table = F.broadcast(table) if len(facts) <= BROADCAST_PATTERNS else table
    discard(slim)
    picked = F.exists("ranges", lambda r: (F.col("h") >= r["lo"]) & (F.col("h") <= r["hi"]) & (F.col("size") > 0) & (F.col("size") <= r["most"]))
    placed = rows.join(table, "pattern").select("row", "size", (F.col("base") + picked.cast("int")).alias("copies"), "source_size", "target")
    return placed.select("row.*", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source_size", "target")


def mixed_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents that the mix takes, once per copy, with the columns of ``df``.

    Texts without words, null ones among them, have size 0 and come as often as
    their source is taken whole; repeated rows are taken equally often.
    """
    mark = unused("_row", df)
    taken = mix(df.select(whole_row(df).alias(mark), name("source").alias("source"), name(text).alias("text")), word_count(F.col("text")), "source")
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return taken.filter(F.col("copies") > 0).select(mark, each.alias("copy")).select(f"{mark}.*")


def digest(df: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken."""
    slim = staged(df.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(slim, "size").select("doc_id", "size", "source_size", "target", "taken", "copies")
