"""Token-ID files in patched frame-of-reference blocks.

A segment holds the ids of some whole documents.  They are cut into blocks of
``BLOCK`` ids; a block stores its minimum, the differences from it in as many
bits as a chosen percentile of them needs, and the few that need more in an
exception list.  An index of block starts gives any range of ids by decoding
only the blocks that it touches.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_at_exit, name, shared_dir, shuffles_removed
from .tokens import default_vocabulary, encode_rows

MAGIC = b"SGPF0001"
BLOCK = 1024
#: Share of a block's values that its width must hold.
PERCENTILE = 0.9
#: Ids after which a segment is closed, at the end of a document.
SEGMENT = 1 << 18
_HEAD = struct.Struct("<8sQQQ")
_U64 = np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values each as rows of ``width`` 64-bit words."""
    out = np.zeros((len(values), width), _U64)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        out[:, word] |= values[:, k] << _U64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, k] >> _U64(64 - shift)
    return out


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), 64), _U64)
    mask = _U64((1 << width) - 1)
    for k in range(64 if width else 0):
        word, shift = divmod(k * width, 64)
        got = words[:, word] >> _U64(shift)
        if shift + width > 64:
            got |= words[:, word + 1] << _U64(64 - shift)
        out[:, k] = got & mask
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of values below 2**32."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.int64)


def encode_blocks(ids: np.ndarray) -> bytes:
    """Ids (unsigned 32-bit) as blocks with their index."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, _U64)
    full[:n] = ids
    if n % BLOCK:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, _U64)
    rest = full - low[:, None]
    need = _bits(rest)
    rank = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    width = np.partition(need, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.int64)
    over = need > width[:, None]
    counts = over.sum(axis=1)
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        mask = _U64((1 << w) - 1)
        packed = _pack((rest[which] & mask).reshape(-1, 64), w).reshape(len(which), -1)
        for k, row in zip(which.tolist(), packed, strict=True):
            if counts[k]:
                spots = np.flatnonzero(over[k])
                parts[k] = row.tobytes() + spots.astype("<u2").tobytes() + rest[k, spots].astype("<u4").tobytes()
            else:
                parts[k] = row.tobytes()
    sizes = np.fromiter((len(p) for p in parts), np.int64, blocks)
    index = np.zeros(blocks, dtype=[("start", "<u8"), ("low", "<u4"), ("width", "<u2"), ("over", "<u2")])
    index["start"], index["low"], index["width"], index["over"] = np.cumsum(sizes) - sizes, low, width, counts
    return index.tobytes() + b"".join(parts)


_INDEX = np.dtype([("start", "<u8"), ("low", "<u4"), ("width", "<u2"), ("over", "<u2")])


def decode_blocks(data: memoryview | bytes, n: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of the ``n`` that :func:`encode_blocks` wrote."""
    hi = n if hi is None else min(hi, n)
    if hi <= lo:
        return np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    index = np.frombuffer(data, _INDEX, blocks)
    body = memoryview(data)[blocks * _INDEX.itemsize :]
    a, b = lo // BLOCK, -(-hi // BLOCK)
    out = np.zeros((b - a, BLOCK), _U64)
    some = index[a:b]
    for w in np.unique(some["width"]).tolist():
        which = np.flatnonzero(some["width"] == w)
        size = BLOCK // 64 * w * 8
        raw = b"".join(bytes(body[s : s + size]) for s in some["start"][which].tolist())
        out[which] = _unpack(np.frombuffer(raw, _U64).reshape(-1, w) if w else np.zeros((len(which) * BLOCK // 64, 0), _U64), w).reshape(len(which), BLOCK)
    for k in np.flatnonzero(some["over"]).tolist():
        m = int(some["over"][k])
        at = int(some["start"][k]) + BLOCK // 64 * int(some["width"][k]) * 8
        spots = np.frombuffer(body[at : at + 2 * m], "<u2")
        out[k, spots] = np.frombuffer(body[at + 2 * m : at + 6 * m], "<u4")
    out += some["low"].astype(_U64)[:, None]
    return out.reshape(-1)[lo - a * BLOCK : hi - a * BLOCK].astype(np.uint32)


def encode_segment(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, number of ids of each document, blocks."""
    return _HEAD.pack(MAGIC, len(lengths), len(ids), BLOCK) + lengths.astype("<u8").tobytes() + encode_blocks(ids)


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each document, ids) of a segment."""
    magic, docs, n, block = _HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = _HEAD.size
    lengths = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
    return lengths, decode_blocks(memoryview(data)[at + 8 * docs :], n)


_SEGMENT_SCHEMA = "part int, segment long, part_start long, n_tokens long, doc_ids array<long>, data binary"


def write_token_files(
    df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, vocabulary: str | None = None
) -> DataFrame:
    """Encode every text, append ``end_id``, and write segments in ``doc_id`` order.

    The container is Parquet: a row per segment with its ids' place in the part
    (``part_start``), its document ids, and the segment itself in ``data``.  Parts
    are ranges of ``doc_id``, in order.  Returns the table that was written.

    Null ids come first; rows with one id are in the order of their texts, so
    repeated rows are alike; a null text is encoded as empty, which leaves the
    end id alone.  An empty table writes an empty table.
    """
    vocab = vocabulary or default_vocabulary()
    rows = df.select(name(doc_id).cast("long").alias("doc_id"), F.coalesce(name(text), F.lit("")).alias("text"))
    # The second key splits a range that one id would fill.
    mark = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark, "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        segment = done = held = 0
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            data = encode_segment(np.concatenate(lengths), np.concatenate(parts))
            out = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int64()), pa.array([done], pa.int64()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["part", "segment", "part_start", "n_tokens", "doc_ids", "data"],
            )
            return out

        for batch in batches:
            names = batch.column(0)
            for piece, ids, counts in encode_rows(batch.column(1), vocab):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id) if len(counts) else ids
                docs += names[piece.lo : piece.hi].to_pylist()
                lengths.append(counts + 1)
                parts.append(ids.astype(np.uint32))
                held += len(ids)
                if held >= SEGMENT:
                    yield close()
                    segment, done, held = segment + 1, done + held, 0
                    docs, lengths, parts = [], [], []
        if docs:
            yield close()

    # Segments are packed already; Parquet's own compression would gain little.
    with shuffles_removed(df.sparkSession):
        ordered.mapInArrow(encode, _SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(_SEGMENT_SCHEMA).parquet(path)


def read_token_files(segments: DataFrame) -> DataFrame:
    """Decode segments: a row per document with ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before; the sums per part are the
    only thing that is gathered, a row per part, hence the broadcast.
    """
    ends = segments.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("held"))
    base = ends.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("base"))
    placed = segments.join(F.broadcast(base), "part").select(
        (F.col("base") + F.col("part_start")).alias("start"), "doc_ids", "data"
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, data in zip(*batch.columns, strict=True):
                lengths, ids = decode_segment(data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.record_batch(
                    [docs.values, pa.array(start.as_py() + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(df: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write all documents as token files in the shared folder and read them back.

    The files are deleted when the driver's JVM ends; :func:`write_token_files`
    writes some that stay.
    """
    path = f"{shared_dir(df.sparkSession)}/sitegrain/tokens-{uuid.uuid4().hex}"
    segments = write_token_files(df, path, vocabulary=vocabulary)
    delete_at_exit(df.sparkSession, path)
    return read_token_files(segments)
