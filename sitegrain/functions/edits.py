"""Edits of texts by offset, of several producers, put together without the texts.

An edit (start, stop, put) replaces the code points from ``start`` to ``stop``.  A
producer's edits are offsets into what it was shown: the text as the producers before
it left it.  :func:`compose` rebases all of them onto the first text, so a page meets
its edits once, however many producers there are.  Redactions are offsets into the
first text; they come last, take what was put inside them along, and can also be
applied alone, when a run has failed.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Edit = tuple[int, int, str]
#: A piece of an edited text: a range of the first text, or what was put before ``start`` (then start = stop).
_Piece = tuple[int, int, str]
#: No text is longer; where the last piece of an edited text ends.
_END = (1 << 31) - 1
EDITS = "array<struct<start:int,stop:int,put:string>>"


def _length(piece: _Piece) -> int:
    return len(piece[2]) if piece[2] else piece[1] - piece[0]


def in_order(edits: Iterable[Edit]) -> list[Edit]:
    """One producer's edits by offset; ``ValueError`` where two overlap or one is no range."""
    out = sorted(edits, key=lambda e: (e[0], e[1]))
    for k, (start, stop, _) in enumerate(out):
        if start < 0 or stop < start:
            raise ValueError(f"no range: {start} to {stop}")
        if k and start < out[k - 1][1]:
            raise ValueError(f"overlap at {start}")
    return out


def _split(piece: _Piece, at: int) -> tuple[_Piece, _Piece]:
    start, stop, put = piece
    return ((start, start, put[:at]), (start, start, put[at:])) if put else ((start, start + at, ""), (start + at, stop, ""))


def _applied(pieces: list[_Piece], edits: list[Edit]) -> list[_Piece]:
    out: list[_Piece] = []
    rest, done = pieces[::-1], 0
    for start, stop, put in edits:
        while done < start and rest:
            piece = rest.pop()
            if done + _length(piece) > start:
                piece, more = _split(piece, start - done)
                rest.append(more)
            out.append(piece)
            done += _length(piece)
        anchor = rest[-1][0] if rest else _END
        if put:
            out.append((anchor, anchor, put))
        while done < stop and rest:
            piece = rest.pop()
            if done + _length(piece) > stop:
                piece, more = _split(piece, stop - done)
                rest.append(more)
            done += _length(piece)
    return out + rest[::-1]


def _as_edits(pieces: list[_Piece]) -> list[Edit]:
    """What differs from the first text, as edits of it."""
    out, done, put = [], 0, ""
    for start, stop, text in pieces:
        if text:
            put += text
        elif start < stop:
            if put or start > done:
                out.append((done, start, put))
            done, put = stop, ""
    if put or done < _END:
        out.append((done, _END, put))
    return out


def compose(producers: Iterable[Iterable[Edit]], redactions: Iterable[Edit] = ()) -> list[Edit]:
    """All edits as one list of edits of the first text."""
    pieces: list[_Piece] = [(0, _END, "")]
    for edits in producers:
        pieces = _applied(pieces, in_order(edits))
    for start, stop, put in reversed(in_order(redactions)):
        kept: list[_Piece] = []
        placed = False
        for piece in pieces:
            if piece[2]:  # put strictly inside the range: goes along with it
                cut = [] if start < piece[0] < stop else [piece]
            else:
                cut = [p for p in ((piece[0], min(piece[1], start), ""), (max(piece[0], stop), piece[1], "")) if p[0] < p[1]]
            for p in cut:
                if not placed and p[0] >= stop and not (p[2] and p[0] == start):
                    placed = True
                    kept += [(start, start, put)] if put else []
                kept.append(p)
        if put and not placed:
            kept.append((start, start, put))
        pieces = kept
    return _as_edits(pieces)


def splice(text: Column, edits: Column) -> Column:
    """A text with its (composed, ordered) edits carried out; null edits leave it as it is."""
    before = F.transform(edits, lambda e, k: F.substring(text, F.when(k == 0, 0).otherwise(F.get(edits, k - 1)["stop"]) + 1, e["start"] - F.when(k == 0, 0).otherwise(F.get(edits, k - 1)["stop"])))
    parts = F.zip_with(before, edits, lambda b, e: F.concat(b, e["put"]))
    last = F.element_at(edits, -1)["stop"]
    # The end of a text may be written as a number beyond it.
    tail = F.when(last < _END, F.substring(text, last + 1, F.lit(_END))).otherwise("")
    return F.when(edits.isNull() | (F.size(edits) == 0), text).otherwise(F.concat(F.array_join(parts, ""), tail))


def staged(edits: DataFrame, keys: list[str], failed: bool = False) -> DataFrame:
    """One row per text: ``keys``, ``edits`` of the first text, ``fault`` (null if none).

    ``edits``: ``keys``, ``turn`` (the producer's place), ``redaction``, ``start``,
    ``stop``, ``put`` (null: nothing).  A producer whose edits overlap or are no ranges is left
    out, as are those after it, since their offsets count on it; redactions never
    are: overlapping ones are joined.  ``failed`` keeps redactions alone.
    """
    rows = edits.where(F.col("redaction")) if failed else edits
    one = F.struct(F.col("redaction"), "turn", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.coalesce("put", F.lit("")).alias("put"))
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all"))

    @F.pandas_udf(f"edits {EDITS}, fault string")
    def put_together(column: pd.Series) -> pd.DataFrame:
        out = []
        for entries in column:
            producers: dict[int, list[Edit]] = {}
            redactions: list[Edit] = []
            fault = None
            for e in entries:
                edit = (int(e["start"]), int(e["stop"]), e["put"])
                if e["redaction"]:
                    redactions.append(edit)
                else:
                    producers.setdefault(e["turn"], []).append(edit)
            sound = []
            for turn in sorted(producers):
                try:
                    sound.append(in_order(producers[turn]))
                except ValueError as error:
                    fault = f"producer {turn}: {error}"
                    break
            out.append(([dict(zip(("start", "stop", "put"), e, strict=True)) for e in compose(sound, joined(redactions))], fault))
        return pd.DataFrame(out, columns=["edits", "fault"])

    done = put_together("all")
    return lists.select(*keys, done.alias("done")).select(*keys, "done.edits", "done.fault")


def joined(edits: Iterable[Edit]) -> list[Edit]:
    """Redactions without overlap: ranges that overlap become one, with what they put in order."""
    out: list[Edit] = []
    for start, stop, put in sorted((max(0, a), max(0, a, b), p) for a, b, p in edits):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop), out[-1][2] + put)
        else:
            out.append((start, stop, put))
    return out
