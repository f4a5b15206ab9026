"""Source divergence audit: how much the sources of a language differ in their words.

Every (lang, source) group has a smoothed distribution over the terms that its
language keeps.  Groups of one language are dealt to slots, a tile of groups each,
and the vocabulary is cut into chunks, so a tile is a small matrix.  Tiles stay in
their partition, while compressed copies of them rotate: in round ``d`` the tile of
slot ``s`` is visited by that of slot ``s + d``, as in a round-robin tournament, so
half as many rounds as there are slots bring every two tiles together once, and a
meeting yields both directions.  Only visitors are moved, a round's results are
written before the next begins, and no round holds more than one visitor per tile.
Terms are ranked by a heap of ``TOP`` per group and chunk.

Odd rows: null text, lang and source are read as ''.  A group without terms takes
part with counts of zero; a language without kept terms has pairs of value 0 and no
terms.  Repeated rows count each as a document.  Ties rank by UTF-8 order of the
item.  Texts of any length are read whole; other columns are ignored, whatever they
are called; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, name, staged

#: Documents of its language that a term must be in.
LEAST = 30
#: Added to every count.
SMOOTH = 5
SCALE = 1_000_000_000
#: Terms that are reported of a group.
TOP = 50
#: Groups of a tile and terms of a chunk, about: a tile is a matrix of 2 MB.
TILE, CHUNK = 8, 1 << 15
#: Distinct terms that a task counts before it hands them on.
HELD = 1 << 18

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KEYS = ["lang", "chunk", "slot"]
_FOUND = "lang string, source string, part string, item string, value long"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of all that is not ASCII."""
    return text.translate(_TERM_BYTES).split()


def counted(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term) with occurrences and documents, added up per task.

    A row with a null term says that the group occurs.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def given() -> pa.RecordBatch:
            rows = [(*g, None, 0, 0) for g in held] + [(*g, t, k, docs[t]) for g, (found, docs) in held.items() for t, k in found.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.binary()] * 3 + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in batches:
            for l, s, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found, docs = held.setdefault((l, s), (Counter(), Counter()))
                words, before = terms(t), len(found)
                found.update(words)
                docs.update(set(words))
                size += len(found) - before
                if size > HELD:
                    yield given()
                    size = 0
        yield given()

    plain = lambda c: F.coalesce(name(c).cast("string"), F.lit("")).cast("binary")
    rows = df.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    out = rows.mapInArrow(scan, "lang binary, source binary, term binary, n long, docs long")
    return out.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")


def kept_counts(df: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n) of terms in ``least`` documents of their language, and a null term per group.

    One shuffle of what :func:`counted` gives: all sums lie in one place per term.
    """
    mark = F.when(F.col("term").isNull(), F.col("source")).otherwise(F.lit(""))
    one = counted(df).withColumn("mark", mark).repartition("lang", "term", "mark")
    one = one.groupBy("lang", "term", "mark", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    both = one.withColumn("docs", F.sum("docs").over(Window.partitionBy("lang", "term", "mark")))
    return both.where((F.col("docs") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n")


def _packed(keys: tuple, entries: pa.Table) -> pa.Table:
    """Places and counts of a group in a chunk as bytes, compressed; there are about ``CHUNK`` at most."""
    at, n = (entries.column(c).to_numpy().astype(kind) for c, kind in (("i", "<i4"), ("n", "<i8")))
    vector = zlib.compress(at.tobytes() + n.tobytes(), 1)
    return pa.table({"lang": [keys[0].as_py()], "source": [keys[1].as_py()], "chunk": pa.array([keys[2].as_py()], pa.int32()), "vector": [vector]})


def _counts(vector: bytes | None, width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    if vector is not None:
        raw = zlib.decompress(vector)
        size = len(raw) // 12
        out[np.frombuffer(raw, "<i4", size)] = np.frombuffer(raw, "<i8", size, 4 * size)
    return out


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / total)``, exact for totals below 9 * 10 ** 15.

    ``total`` has the smoothing of all terms in it, so it is at least each numerator.
    """
    whole, rest = np.divmod(counts + SMOOTH, total)
    for _ in range(3):  # long division, three decimal places at a time
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def _tile(rows: list[dict]) -> tuple[list[str], np.ndarray]:
    width = rows[0]["width"]
    matrix = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        if width:
            matrix[k] = shares(_counts(r["vector"], width), r["total"])
    return [r["source"] for r in rows], matrix


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], ["lang", "source", "part", "item", "value"])


def _meeting(resident: pa.Table, visitor: pa.Table) -> pa.Table:
    """Sums of differences between every group of one tile and every one of another, both ways."""
    if not resident.num_rows or not visitor.num_rows:
        return _found([])
    here, there = resident.to_pylist(), visitor.to_pylist()
    names, own = _tile(here)
    others, theirs = _tile(there)
    out = []
    for a, row in zip(names, own, strict=True):
        for b, value in zip(others, np.abs(theirs - row).sum(axis=1).tolist(), strict=True):
            out += [(here[0]["lang"], a, "pair", b, value), (here[0]["lang"], b, "pair", a, value)]
    return _found(out)


def _at_home(resident: pa.Table, lexicon: pa.Table) -> pa.Table:
    """Pairs inside a tile, and the terms by which each group exceeds its language most."""
    if not resident.num_rows:
        return _found([])
    rows = resident.to_pylist()
    names, own = _tile(rows)
    lang, out = rows[0]["lang"], []
    for k, a in enumerate(names):
        for b, value in zip(names[k + 1 :], np.abs(own[k + 1 :] - own[k]).sum(axis=1).tolist(), strict=True):
            out += [(lang, a, "pair", b, value), (lang, b, "pair", a, value)]
    if lexicon.num_rows:
        words = lexicon.to_pylist()[0]
        entries = sorted(words["entries"], key=lambda e: e["i"])
        common = shares(np.array([e["n"] for e in entries], np.int64), words["total"])
        for k, r in enumerate(rows):
            excess = np.where(_counts(r["vector"], r["width"]) > 0, own[k] - common, 0)
            above = np.flatnonzero(excess > 0)
            if len(above) > TOP:  # the heap's floor; what ties with it stays
                floor = np.partition(excess[above], len(above) - TOP)[len(above) - TOP]
                above = above[excess[above] >= floor]
            best = sorted((-int(excess[i]), entries[i]["term"]) for i in above)[:TOP]
            out += [(lang, names[k], "term", term, -value) for value, term in best]
    return _found(out)


def audit(df: DataFrame, least: int = LEAST, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """Rows (lang, source, part, item, value, rank); parts ``pair`` and ``term``.

    Staged tables but the last are deleted on the way.
    """
    kept = staged(kept_counts(df, least), "terms")
    words = kept.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    words = staged(words, "vocabulary")
    langs = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all"))
    most = langs.agg(F.max("kept")).first()[0] or 0
    chunks = max(1, math.ceil(most / chunk))
    of_chunk = F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk")
    numbered = words.select("lang", "term", "n", of_chunk).withColumn("i", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    numbered = staged(numbered, "numbered")

    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).alias("slots"))
    stats = staged(sizes.join(langs, "lang", "left").fillna(0, ["kept", "all"]), "langs")
    rounds = (stats.agg(F.max("slots")).first()[0] or 0) // 2
    widths = numbered.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    smooth = F.col("kept") * SMOOTH
    slot = F.pmod(F.xxhash64("source"), F.col("slots")).alias("slot")
    seats = groups.join(stats, "lang").select("lang", "source", (F.col("own") + smooth).alias("total"), slot, "slots", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    entries = kept.join(numbered.select("lang", "term", "chunk", "i"), ["lang", "term"])
    vectors = entries.groupBy("lang", "source", "chunk").applyInArrow(_packed, "lang string, source string, chunk int, vector binary")
    tiles = seats.join(vectors, ["lang", "source", "chunk"], "left").join(widths, ["lang", "chunk"], "left").fillna(0, ["width"])
    tiles = staged(tiles.select(*_KEYS, "slots", "source", "total", F.col("width").cast("int").alias("width"), "vector"), "tiles")
    lexicon = numbered.groupBy("lang", "chunk").agg(F.collect_list(F.struct("i", "term", "n")).alias("entries"))
    lexicon = lexicon.join(stats, "lang").select("lang", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), (F.col("all") + smooth).alias("total"), "entries")

    resident = tiles.repartition(*_KEYS).persist()
    found = [staged(resident.groupBy(*_KEYS).cogroup(lexicon.groupBy(*_KEYS)).applyInArrow(_at_home, _FOUND), "home")]
    for distance in range(1, rounds + 1):
        # With an even number of slots the last round would bring every two together twice.
        seat = F.pmod(F.col("slot") - distance, F.col("slots"))
        comes = (F.col("slots") > 2 * distance) | ((F.col("slots") == 2 * distance) & (seat < distance))
        visitors = tiles.where(comes).withColumn("slot", seat)
        found.append(staged(resident.groupBy(*_KEYS).cogroup(visitors.groupBy(*_KEYS)).applyInArrow(_meeting, _FOUND), "round"))
    resident.unpersist()
    discard(kept, words, numbered, stats, tiles)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = every.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranking = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = every.withColumn("rank", F.row_number().over(ranking)).where(f"part = 'pair' OR rank <= {TOP}")
    return out.select("lang", "source", "part", "item", "value", "rank")


def digest(documents: DataFrame) -> DataFrame:
    """The audit of ``documents`` with the stated parameters."""
    return audit(documents)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(DISTINCT k.term) AS v FROM g LEFT JOIN k USING (lang) GROUP BY g.lang),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.n + 5 * v.v))::BIGINT AS p
  FROM g JOIN k USING (lang) JOIN t USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(p.n) + 5)) // (any_value(l.n) + 5 * any_value(v.v)))::BIGINT AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM t GROUP BY lang) l USING (lang) GROUP BY lang, term),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e
QUALIFY part = 'pair' OR rank <= 50"""
