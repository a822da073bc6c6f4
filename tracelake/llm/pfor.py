"""Patched frame-of-reference files of unsigned 32-bit ids.

A stream is cut into blocks of `BLOCK` values. A block keeps its minimum, the values less that minimum packed at
the width that holds the given percentile of them, and the rest as exceptions (place in the block, high bits).
An index of block starts lets a reader decode any range of ids alone.

File, all integers little-endian:
  magic 8 bytes | u64 documents | u64 ids | u64 bytes of the lengths' stream
  u64 ids' stream's place
  i64 doc_id of each document
  lengths stream, ids stream; a stream is
    u64 values | u64 blocks | u64 block starts (blocks + 1, from the stream's first block)
    blocks: u32 minimum | u8 width | u16 exceptions | packed values | u16 places | u32 high parts
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PFORIDS1"
BLOCK = 256
#: Blocks whose single bits are in memory at a time.
AT_ONCE = 2048
PERCENTILE = 90.0
_HEAD = struct.Struct("<IBH")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    values = np.ascontiguousarray(values, dtype="<u4")
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return struct.pack("<QQQ", 0, 0, 0)
    padded = np.concatenate((values, np.full(blocks * BLOCK - n, values[-1], dtype="<u4"))).reshape(blocks, BLOCK)
    low = padded.min(axis=1)
    rest = padded - low[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(BLOCK * percentile / 100)) - 1))
    width = _widths(np.partition(rest, rank, axis=1)[:, rank])
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    packed: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        for rows in np.array_split(same, -(-len(same) // AT_ONCE)) if w else ():
            bits = np.unpackbits(np.ascontiguousarray(rest[rows]).view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little", count=int(w))
            body = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            for r, b in zip(rows.tolist(), body, strict=True):
                packed[r] = b.tobytes()
    counts = over.sum(axis=1)
    where_row, where = np.nonzero(over)
    high = (rest[where_row, where] >> width[where_row].astype(np.uint32)).astype("<u4")
    place = where.astype("<u2")
    ends = np.cumsum(counts)
    out, starts, at = [], [0], 0
    for k in range(blocks):
        e, c = int(ends[k]), int(counts[k])
        block = _HEAD.pack(int(low[k]), int(width[k]), c) + packed[k] + place[e - c : e].tobytes() + high[e - c : e].tobytes()
        out.append(block)
        at += len(block)
        starts.append(at)
    return struct.pack("<QQ", n, blocks) + np.array(starts, dtype="<u8").tobytes() + b"".join(out)


def _decode_blocks(data: bytes, starts: np.ndarray, base: int, first: int, last: int) -> np.ndarray:
    """Values of blocks first..last-1, padding included."""
    m = last - first
    heads = [_HEAD.unpack_from(data, base + int(starts[k])) for k in range(first, last)]
    low = np.array([h[0] for h in heads], dtype=np.uint32)
    width = np.array([h[1] for h in heads], dtype=np.int64)
    count = np.array([h[2] for h in heads], dtype=np.int64)
    out = np.zeros((m, BLOCK), dtype=np.uint32)
    view = np.frombuffer(data, dtype=np.uint8)
    body = base + starts[first:last].astype(np.int64) + _HEAD.size
    for w in np.unique(width):
        if w:
            same = np.flatnonzero(width == w)
            size = BLOCK * int(w) // 8
            for rows in np.array_split(same, -(-len(same) // AT_ONCE)):
                raw = view[body[rows][:, None] + np.arange(size)]
                bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
                padded = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
                padded[:, :, : int(w)] = bits
                out[rows] = np.packbits(padded, axis=2, bitorder="little").view("<u4").reshape(len(rows), BLOCK)
    if count.any():
        rows = np.repeat(np.arange(m), count)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        at = (body + BLOCK * width // 8)[rows]
        place = view[(at + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2").reshape(-1)
        high = view[(at + 2 * count[rows] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
        out[rows, place] |= high << width[rows].astype(np.uint32)
    return out + low[:, None]


def decode(data: bytes, at: int = 0, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values start..stop-1 of the stream that begins at `at`; only the blocks that hold them are read."""
    n, blocks = struct.unpack_from("<QQ", data, at)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    starts = np.frombuffer(data, dtype="<u8", count=blocks + 1, offset=at + 16)
    first, last = start // BLOCK, -(-stop // BLOCK)
    values = _decode_blocks(data, starts, at + 16 + 8 * (blocks + 1), first, last).reshape(-1)
    return values[start - first * BLOCK : stop - first * BLOCK]


def write_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A whole file's bytes. Document k has the next lengths[k] of the ids."""
    lengths_stream = encode(lengths, percentile)
    doc_bytes = np.asarray(doc_ids, dtype="<i8").tobytes()
    place = 40 + len(doc_bytes) + len(lengths_stream)
    return MAGIC + struct.pack("<QQQQ", len(lengths), len(ids), len(lengths_stream), place) + doc_bytes + lengths_stream + encode(ids, percentile)


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of ids")
    docs, n, _, place = struct.unpack_from("<QQQQ", data, 8)
    doc_ids = np.frombuffer(data, dtype="<i8", count=docs, offset=40)
    lengths = decode(data, 40 + 8 * docs)
    ids = decode(data, place)
    if len(ids) != n or len(lengths) != docs or int(lengths.sum(dtype=np.uint64)) != n:
        raise ValueError("the file's counts do not agree")
    return doc_ids, lengths, ids


def read_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1 of a file, through the index of block starts."""
    return decode(data, struct.unpack_from("<Q", data, 32)[0], start, stop)
