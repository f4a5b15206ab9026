"""Merkle manifest of a dataset: a hash tree over ranked rows, with inclusion proofs.

Every row is a leaf.  In each group the leaves stand in order of their id, and runs
of 16 consecutive nodes are hashed into one, level by level, until one is left, the
group's ``subroot``; the subroots, in order of the group, are hashed likewise into
the ``root``.

Ranks are exact without a global sort.  An id is a string of hex digits; rows are
counted by the leading digits, longer and longer ones, until no bucket holds more
than ``BUCKET`` rows.  A row's rank is the number of rows before its prefix among
the siblings of each level of these histograms, plus its place in its own bucket.
The base-16 digits of a rank then name the trie nodes above a leaf, so two levels
are reduced in one place, keyed by the longest prefix (``rank >> 8``), and the
next two by the next.  Groups of any size are spread over many keys.

Odd rows: null fields hash as ``-``; a null id is first in its group, a null group
first of all.  Rows that share an id stand in order of their leaf; equal rows are
interchangeable, and very many of them are numbered by ranges, not in one place.
An empty table has no root and gives no rows.  Texts of any length are hashed
whole; other columns of the table are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, name, staged

FANOUT = 16
#: Levels that are reduced in one place; a key there has 16 ** LEVELS nodes at most.
LEVELS = 2
#: Rows of one digit prefix that are ranked in one place.
BUCKET = 1024
#: Digits by which a level of the histograms goes deeper at most, so siblings are bounded.
DIGITS = 3

_PATH = "array<struct<l:string,r:string>>"


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 in hex over all fields: ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digits(df: DataFrame, column: str) -> Column:
    """Hex digits that sort as the column does, ended by ``!``; null is the end alone."""
    value = name(column)
    if df.select(value).schema[0].dataType.typeName() in ("byte", "short", "integer", "long"):
        digits = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        digits = F.hex(value.cast("string").cast("binary"))
    return F.concat(F.coalesce(digits, F.lit("")), F.lit("!"))


def ranked(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with ``r``, from 0 in each ``g`` by ``key``, and ``total``, the rows of ``g``; tables it holds.

    ``rows`` is a staged table with strings ``g`` and ``key``, both without nulls,
    where no key is a prefix of another, and what else it has follows from them.
    """
    ends = rows.where("key NOT LIKE '!%'").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    common = 0
    if ends.lo is not None:  # digits that all keys share tell nothing; a key without any is left as it is
        common = next((k for k, (a, b) in enumerate(zip(ends.lo, ends.hi, strict=False)) if a != b or "!" in (a, b)), 0)
    rows = rows.withColumn("digits", F.when(F.col("key").startswith("!"), F.col("key")).otherwise(F.expr(f"substring(key, {common + 1})")))
    cuts, finest = [DIGITS], None
    while True:
        told = F.xxhash64("digits")
        finest = staged(
            rows.groupBy("g", F.substring("digits", 1, cuts[-1]).alias("b")).agg(
                F.count("*").alias("n"), F.min(told).alias("one"), F.max(told).alias("other"), F.max(F.length("digits")).alias("longest")
            ),
            "digits",
        )
        crowded = finest.where((F.col("n") > BUCKET) & (F.col("longest") > cuts[-1]))
        worst = crowded.agg(F.max(F.when(F.col("one") != F.col("other"), F.col("n"))).alias("mixed"), F.max("longest").alias("longest")).first()
        if worst.longest is None:
            break
        discard(finest)
        # Buckets of equal keys alone go to the end at once: below them there is one sibling.
        cuts.append(cuts[-1] + min(DIGITS, max(1, math.ceil(math.log(worst.mixed / BUCKET, 16)))) if worst.mixed else worst.longest)
    levels = [finest.select("g", "b", "n")]
    for cut in reversed(cuts[:-1]):
        levels.append(levels[-1].groupBy("g", F.substring("b", 1, cut).alias("b")).agg(F.sum("n").alias("n")))
    starts, above = None, 0
    for cut, level in zip(cuts, reversed(levels), strict=True):
        siblings = Window.partitionBy("g", "p")
        before = siblings.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("p", F.substring("b", 1, above)).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if starts is None:
            starts = level.select("g", "b", "n", "start", F.sum("n").over(siblings).alias("total"))
        else:
            up = starts.select("g", F.col("b").alias("p"), F.col("start").alias("base"), "total")
            starts = level.join(up, ["g", "p"]).select("g", "b", "n", (F.col("start") + F.col("base")).alias("start"), "total")
        above = cut
    starts = staged(starts, "starts")
    kept = [c for c in rows.columns if c not in ("g", "digits", "key")]
    placed = rows.withColumn("b", F.substring("digits", 1, cuts[-1])).join(starts, ["g", "b"])
    inside = Window.partitionBy("g", "b").orderBy("digits")
    out = placed.where(f"n <= {BUCKET}").select("g", "total", (F.col("start") + F.row_number().over(inside) - 1).alias("r"), *kept)
    if starts.where(f"n > {BUCKET}").limit(1).count():
        whole = placed.where(f"n > {BUCKET}").groupBy("g", "b", "total", "start", "n").agg(F.any_value(F.struct(*kept)).alias("row"))
        ranges = whole.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(BUCKET)))).repartition("start", "at")
        each = ranges.withColumn("at", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + BUCKET, F.col("n")) - 1)))
        out = out.unionByName(each.select("g", "total", (F.col("start") + F.col("at")).alias("r"), "row.*"))
    return out, [finest, starts]


def _reduce(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two levels up: the blocks with all that is in them, staged, and the nodes above.

    ``nodes``: ``g``, ``total`` nodes in it, place ``r``, hash ``h``, struct ``p`` to carry.
    A group of one node stays as it is.
    """
    kids = nodes.withColumn("block", F.shiftright("r", 4 * LEVELS)).repartition("g", "block").groupBy("g", "block", "total", F.shiftright("r", 4).alias("run"))
    kids = kids.agg(F.sort_array(F.collect_list(F.struct("r", "h", "p"))).alias("kids"))
    joined = lambda hashes: F.sha2(F.array_join(hashes, "").cast("binary"), 256)
    first = F.when(F.col("total") > 1, joined(F.col("kids.h"))).otherwise(F.col("kids")[0]["h"])
    runs = kids.withColumn("h", first).groupBy("g", "block", "total").agg(F.sort_array(F.collect_list(F.struct("run", "h", "kids"))).alias("runs"))
    fewer = F.ceil(F.col("total") / FANOUT)
    blocks = staged(runs.withColumn("h", F.when(fewer > 1, joined(F.col("runs.h"))).otherwise(F.col("runs")[0]["h"])), "blocks")
    above = blocks.select("g", F.ceil(fewer / FANOUT).cast("long").alias("total"), F.col("block").alias("r"), "h", F.lit(None).cast("struct<x:int>").alias("p"))
    return blocks, above


def _beside(hashes: Column, at: Column, more: Column) -> Column:
    """The siblings of a node left and right of it, as a path of one step; none at the top."""
    left = F.array_join(F.slice(hashes, 1, at), "")
    right = F.array_join(F.slice(hashes, at + 2, FANOUT), "")
    return F.when(more, F.array(F.struct(left.alias("l"), right.alias("r")))).otherwise(F.array().cast(_PATH))


def _expand(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """From paths of blocks (``g``, ``r``, ``path`` and more) to those of the nodes in them."""
    kept = [c for c in above.columns if c not in ("g", "r", "path")]
    both = blocks.drop("h").withColumnRenamed("block", "r").join(above, ["g", "r"])
    runs = both.select("g", "total", "path", *kept, F.col("runs.h").alias("peers"), F.posexplode("runs").alias("i", "run"))
    up = F.concat(_beside(F.col("peers"), F.col("i"), F.col("total") > FANOUT), "path")
    kids = runs.select("g", "total", *kept, up.alias("path"), F.col("run.kids.h").alias("peers"), F.posexplode("run.kids").alias("j", "kid"))
    path = F.concat(_beside(F.col("peers"), F.col("j"), F.col("total") > 1), "path")
    return kids.select("g", F.col("kid.r").alias("r"), F.col("kid.p").alias("p"), path.alias("path"), *kept)


def _tower(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Blocks of all levels from the bottom, the one node of each group, tables to keep."""
    floors = []
    while True:
        blocks, nodes = _reduce(nodes)
        floors.append(blocks)
        most = nodes.agg(F.max("total")).first()[0]
        if most is None or most <= 1:
            return floors, nodes, floors


def proofs(df: DataFrame, id_column: str, group: str, fields: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: its id, leaf, subroot, root and ``path`` to the root.

    ``path`` is an array from the bottom up of (l, r), the concatenated hashes of the
    siblings left and right of it, for each level that hashes.  ``carry`` has columns
    to compute from ``df`` and pass on; they must follow from ``fields`` and the id.
    Staged tables stay until the application ends.
    """
    of_group = F.coalesce(F.concat(F.lit("1"), name(group).cast("string")), F.lit("0"))
    leaf = leaf_hash([name(c) for c in fields])
    own = F.struct(name(id_column).alias("id"), *[c.alias(k) for k, c in (carry or {}).items()])
    leaves = df.select(of_group.alias("g"), F.concat(_digits(df, id_column), leaf).alias("key"), leaf.alias("h"), own.alias("p"))
    leaves = staged(leaves, "leaves")
    rows, _ = ranked(leaves)
    floors, tops, _ = _tower(rows.select("g", "total", "r", "h", "p"))
    discard(leaves)
    seeds = tops.select(F.lit("").alias("g"), F.concat(F.hex(F.col("g").cast("binary")), F.lit("!")).alias("key"), "h", F.struct(F.col("g").alias("of"), F.col("h").alias("subroot")).alias("p"))
    seeds = staged(seeds, "subroots")
    rows, _ = ranked(seeds)
    upper, apex, _ = _tower(rows.select("g", "total", "r", "h", "p"))
    paths = apex.select("g", "r", F.array().cast(_PATH).alias("path"), F.col("h").alias("root"))
    for blocks in reversed(upper):
        paths = _expand(blocks, paths).drop("p") if blocks is not upper[0] else _expand(blocks, paths)
    paths = paths.select(F.col("p.of").alias("g"), F.lit(0).cast("long").alias("r"), "path", F.col("p.subroot").alias("subroot"), "root")
    for blocks in reversed(floors):
        paths = _expand(blocks, paths).drop("p") if blocks is not floors[0] else _expand(blocks, paths)
    leaf_of = F.col("p.*")
    return paths.select(leaf_of, F.col("path"), "subroot", "root").withColumnRenamed("id", id_column)


def proof_hash(path: Column) -> Column:
    """SHA-256 over all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["l"], below, step["r"]).cast("binary"), 256))


_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(documents: DataFrame) -> DataFrame:
    """Manifest of ``documents`` by source, and what a check of tampered rows finds.

    Where 5 divides the CRC-32 of the decimal id, the text is tampered with by
    lower-casing A to Z; such a row verifies only if that changes nothing.  A row
    without an id is never tampered with.
    """
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in _FIELDS]
    tampered = F.when(changed, leaf_hash([*fields[:-1], lower])).otherwise(F.lit(None))
    rows = proofs(documents, "doc_id", "source", _FIELDS, {"leaf": leaf_hash(fields), "tampered": tampered})
    top = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), top.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 6, upper: int = 3) -> str:
    """DuckDB SQL for :func:`digest`, for groups of up to ``16 ** levels`` rows and ``16 ** upper`` groups."""
    field = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field.format(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(a, b))"
    crc = f"xor(list_reduce(list_transform(str_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: {step}, 4294967295::BIGINT), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS t FROM documents)",
        "t0 AS (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d)",
        "f0 AS (SELECT rid, g, i, t AS acc, '' AS proof FROM t0)",
    ]

    def rise(k: int) -> None:
        left, right = (f"coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (k.i {op} f.i), '')" for op in ("<", ">"))
        parts.append(f"t{k + 1} AS (SELECT g, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM t{k} GROUP BY g, i // 16)")
        parts.append(
            f"f{k + 1} AS (SELECT f.rid, f.g, f.i // 16 AS i, CASE WHEN any_value(k.n) > 1 THEN sha256({left} || any_value(f.acc) || {right}) ELSE any_value(f.acc) END AS acc, any_value(f.proof) || {left} || {right} AS proof "
            f"FROM f{k} f JOIN t{k} k ON k.g = f.g AND k.i // 16 = f.i // 16 GROUP BY f.rid, f.g, f.i)"
        )

    for k in range(levels):
        rise(k)
    top = levels + 1
    parts.append(f"t{top} AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS of FROM t{levels})")
    parts.append(f"f{top} AS (SELECT f.rid, '' AS g, t.i, f.acc, f.proof FROM f{levels} f JOIN t{top} t ON t.of = f.g)")
    for k in range(top, top + upper):
        rise(k)
    end = top + upper
    return f"""WITH {", ".join(parts)}
SELECT t0.doc_id, t0.h AS leaf, s.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = r.h AS verified
FROM t0 JOIN f{end} f USING (rid) JOIN t{levels} s ON s.g = t0.g, t{end} r"""
