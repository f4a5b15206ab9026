"""Exact byte-level BPE encoding of whole texts, and token counts from it.

A text is split into pre-tokens by a vectorised form of the tokenizer's own
split rule; each distinct pre-token is encoded once per worker by the BPE model
of the ``tokenizers`` library, and ids are put together by indexing.  Rows the
split rule below does not cover (scripts beyond Latin, texts that may hold a
special token) go to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import name, staged
from .kernels import U64, Piece, mix, pieces, powers

# White_Space below U+3000, as the split rule's \s has it.
_WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F)
_OTHER, _LETTER, _NUMBER, _SPACE, _FOREIGN = range(5)
#: Distinct pre-tokens that a worker keeps before it starts anew.
CACHE = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; ``_FOREIGN`` beyond Latin and general punctuation."""
    import unicodedata

    out = np.full(0x110000, _FOREIGN, np.uint8)
    for c in [*range(0x250), *range(0x2000, 0x2070)]:
        kind = unicodedata.category(chr(c))[0]
        out[c] = _SPACE if c in _WHITE else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    return out


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes pieces of a batch; made once per worker and vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, token: bytes) -> bytes:
        if (got := self.cache.get(token)) is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            letters = token.decode("latin-1").translate(_byte_letters())
            got = np.array([t.id for t in self.model.tokenize(letters)], np.uint32).tobytes()
            self.cache[token] = got
        return got

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows of the piece one after another, number of ids of each)."""
        data, offsets = piece.data, piece.offsets
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        points = np.frombuffer(bytes(data).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        bounds = np.searchsorted(at, offsets)
        kinds = _classes()[points]
        odd = np.flatnonzero((kinds == _FOREIGN) | ((points == ord("<")) & (np.append(points[1:], 0) == ord("|"))))
        slow = np.unique(np.searchsorted(bounds, odd, side="right") - 1)
        starts = self._starts(points, kinds, bounds)
        if not len(slow):
            return self._gather(data, at, starts, bounds)
        ids, counts = [], np.zeros(rows, np.int64)
        lo = 0
        for k in [*slow.tolist(), rows]:
            if k > lo:
                a, b = bounds[lo], bounds[k]
                part = starts[(starts >= a) & (starts < b)]
                got, n = self._gather(data, at, part, bounds[lo : k + 1])
                ids.append(got)
                counts[lo:k] = n
            if k < rows:
                text = bytes(data[offsets[k] : offsets[k + 1]]).decode("utf-8", "replace")
                got = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
                ids.append(got)
                counts[k] = len(got)
            lo = k + 1
        return np.concatenate(ids), counts

    @staticmethod
    def _starts(points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin.

        A run of letters, of numbers or of other marks is one, with a single
        blank before it; of a run of white space all but the last character is
        one if something follows; the seven English contractions stand alone.
        """
        n = len(points)
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 255, kinds[:-1]
        after = np.empty(n, np.uint8)
        after[-1], after[:-1] = 255, kinds[1:]
        blank = np.zeros(n, bool)
        blank[1:] = points[:-1] == 0x20
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        before[heads] = 255
        blank[heads] = False
        tails = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        after[tails] = 255
        space = kinds == _SPACE
        start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != 255)), (before != kinds) & ~blank)
        for i in np.flatnonzero((points == ord("'")) & start).tolist():
            end = int(bounds[np.searchsorted(bounds, i, side="right")])
            tail = "".join(map(chr, points[i + 1 : min(i + 3, end)].tolist()))
            width = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
            if width:
                start[i + 1 : i + width] = False
                if i + width < end:
                    start[i + width] = True
        return np.flatnonzero(start)

    def _gather(self, data, at, starts, bounds) -> tuple[np.ndarray, np.ndarray]:
        rows = len(bounds) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        stop = at[bounds[-1]] if bounds[-1] < len(at) else len(data)
        begin = at[starts]
        end = np.append(begin[1:], stop)
        lengths = end - begin
        body = data[begin[0] : stop]
        heads = begin - begin[0]
        table = powers(int(lengths.max()), 1)
        place = np.arange(len(body)) - np.repeat(heads, lengths)
        keys = mix(np.add.reduceat((body.astype(U64) + U64(1)) * table[place], heads) + lengths.astype(U64))
        _, one, back = np.unique(keys, return_index=True, return_inverse=True)
        raw = bytes(body)
        known = [self._ids(raw[a:b]) for a, b in zip(heads[one].tolist(), (heads + lengths)[one].tolist(), strict=True)]
        sizes = np.fromiter((len(x) for x in known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), np.uint32)
        firsts = np.cumsum(sizes) - sizes
        each = sizes[back]
        total = int(each.sum())
        shift = np.repeat(firsts[back] - (np.cumsum(each) - each), each)
        ids = pool[np.arange(total) + shift]
        run = np.append(0, np.cumsum(each))
        marks = np.searchsorted(starts, bounds)
        return ids, run[marks[1:]] - run[marks[:-1]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_rows(column: pa.Array, path: str) -> Iterator[tuple[Piece, np.ndarray, np.ndarray]]:
    """Each piece of a string column with its ids and the number of ids per row."""
    enc = encoder(path)
    for piece in pieces(column):
        ids, counts = enc.encode(piece)
        yield piece, ids, counts


def token_lengths(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One column ``length``: the number of ids of each text (null: 0 ids)."""
    path = vocabulary or default_vocabulary()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [n for _, _, n in encode_rows(batch.column(0), path)]
            yield pa.record_batch([pa.array(np.concatenate(got) if got else [], pa.int64())], ["length"])

    return df.select(name(text)).mapInArrow(lengths, "length long")


def length_histogram(df: DataFrame, text: str = "text", vocabulary: str | None = None, block: int = 256) -> DataFrame:
    """Exact histogram of encoded lengths with its suffix sums.

    Per length that occurs: ``n_docs`` of that length; ``docs_from`` and
    ``tokens_from`` of at least that length; ``total_tokens`` of all documents;
    ``truncated_tokens``, what is left of all documents if each is cut to that
    length; ``quantile``, the share of documents not longer.  They answer any
    context limit L by the first row with ``length`` >= L: the documents below it
    are whole, the others give L each (see :func:`truncated_total`).

    Lengths are counted before they meet, so a frequent length is one row per
    task, and the counts are staged: texts are encoded once.  Suffix sums run by
    blocks of ``block`` lengths, then over blocks.  Null and empty texts have
    length 0; repeated rows count one by one; an empty table gives an empty result.
    """
    counts = token_lengths(df, text, vocabulary).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = staged(counts.withColumn("block", F.floor(F.col("length") / block)), "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    later = blocks.select(
        "block",
        zero(F.sum("d").over(after)).alias("later_docs"),
        zero(F.sum("t").over(after)).alias("later_tokens"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = counts.select(
        "*",
        F.sum("n_docs").over(down).alias("docs"),
        F.sum(F.col("n_docs") * F.col("length")).over(down).alias("tokens"),
    )
    out = own.join(later, "block").select(
        "length",
        "n_docs",
        (F.col("docs") + F.col("later_docs")).alias("docs_from"),
        (F.col("tokens") + F.col("later_tokens")).alias("tokens_from"),
        "total_tokens",
        "all_docs",
    )
    return out.select(
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row ``tokens``: what is left if every document is cut to ``limit`` ids."""
    first = F.when(F.col("length") >= limit, F.struct("length", "docs_from", "tokens_from"))
    return histogram.agg(
        F.max("total_tokens").alias("total"), F.min(first).alias("first")
    ).select(
        (
            F.coalesce(F.col("total"), F.lit(0))
            - F.coalesce(F.col("first.tokens_from") - F.col("first.docs_from") * limit, F.lit(0))
        ).alias("tokens")
    )
