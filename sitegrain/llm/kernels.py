"""Vectorised text kernels shared by the Python-side operators.

Everything here is plain numpy over the UTF-8 bytes of a batch of texts: no
Spark import, no per-word Python objects.  A batch is cut into pieces of a few
MB so that the temporaries stay bounded however long the batch is; one text is
never cut, except where a function says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words: the complement of ``[^\x20\x09-\x0D]``.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACE_BYTES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def byte_values(seed: int) -> np.ndarray:
    """256 random 64-bit values, the same for the same seed everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=U64)


_BYTE64 = (byte_values(11), byte_values(12))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, which: int = 0) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2**64; -1: of the first one's inverse."""
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = _BASES[which] if which >= 0 else U64(pow(int(_BASES[0]), -1, 1 << 64))
        steps = np.full(max(n, 1 << 12), base, dtype=U64)
        steps[0] = U64(1)
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 20:
            _powers[which] = have
    return have[:n]


class Piece(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = 2 << 20) -> Iterator[Piece]:
    """Cut a string column (null: empty) into pieces of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Piece(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Words(NamedTuple):
    """Words of a piece: byte bounds, hashes, and word bounds of each row."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def words(piece: Piece, lower: bool = False, which: int = 0) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, with a 64-bit hash of each."""
    data, offsets = piece.data, piece.offsets
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = True
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[begins[1:] - 1] = True
    last &= inside
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if len(starts):
        at = np.flatnonzero(inside)
        lengths = ends - starts
        heads = np.cumsum(lengths) - lengths
        place = np.arange(len(at)) - np.repeat(heads, lengths)
        table = powers(int(lengths.max()), which)
        hashes = mix(np.add.reduceat(_BYTE64[which][data[at]] * table[place], heads) + lengths.astype(U64))
    else:
        hashes = np.zeros(0, U64)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` symbols; rows are not told apart here."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = np.random.Generator(np.random.PCG64(1000 + salt)).integers(0, 2**63, width, dtype=U64) * U64(2) + U64(1)
    out = np.zeros(n, U64)
    for k in range(width):
        out += mix(hashes[k : k + n] ^ factors[k]) if width <= 5 else hashes[k : k + n] * factors[k]
    return mix(out)


def run_hash(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` symbols by doubling: about log2(width) passes."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, have, cur, span, rest = None, 0, symbols, 1, width
    while rest:
        if rest & 1:
            out = cur if out is None else _join(out, cur, have, span)
            have += span
        rest >>= 1
        if rest:
            cur = _join(cur, cur, span, span)
            span *= 2
    return out[:n]


def _join(left: np.ndarray, right: np.ndarray, shift: int, span: int) -> np.ndarray:
    """Hash of a left run followed, ``shift`` symbols on, by a right run."""
    n = min(len(left), len(right) - shift)
    out = left[:n] * U64(0xC2B2AE3D27D4EB4F) + right[shift : shift + n]
    out *= U64(0x9FB21C651E98DF25 + 2 * span)
    out ^= out >> U64(32)
    return out
