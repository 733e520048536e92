"""Patched frame-of-reference blocks of whole numbers below 2 ** 32, in numpy.

A block holds 256 values (the last one of a file fewer).  The block's minimum
is subtracted and the rest packed with a common width, the one that a given
percentile of the block's values needs; what the others have above that width
goes to an exception list of places and high bits.

    block    minimum u32, exceptions u16, width u8, values - 1 u8; packed low
             bits, value by value from the lowest bit (width * 32 bytes);
             places of the exceptions u8 each; their high bits u32 each
    file     magic; blocks; starts of the blocks u64 each; the caller's own
             bytes; trailer: values u64, blocks u64, place of the starts u64,
             place and length of the own bytes u64 each, CRC-32 of all from the starts on u32, magic
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"PFORIDS1"
BLOCK = 256
PERCENTILE = 90
#: blocks packed together
AT_ONCE = 2048
HEAD = np.dtype([("least", "<u4"), ("outliers", "<u2"), ("width", "u1"), ("last", "u1")])
TRAILER = struct.Struct("<QQQQQI8s")


def pack_blocks(values: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks of ``values`` and the size of each in bytes."""
    chunks, sizes = [], []
    for at in range(0, len(values), AT_ONCE * BLOCK):
        data, size = _pack(values[at:at + AT_ONCE * BLOCK].astype(np.uint32), percentile)
        chunks.append(data)
        sizes.append(size)
    return b"".join(chunks), np.concatenate(sizes) if sizes else np.empty(0, np.int64)


def _pack(values: np.ndarray, percentile: int) -> tuple[bytes, np.ndarray]:
    n = -(-len(values) // BLOCK)
    count = np.full(n, BLOCK)
    count[-1] = len(values) - (n - 1) * BLOCK
    rows = np.append(values, np.repeat(values[-1:], n * BLOCK - len(values))).reshape(n, BLOCK)
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    rest[-1, count[-1]:] = 0
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    # the percentile of the block's own values: what fills the last block counts as no bits, before them
    rank = BLOCK - count + np.maximum(-(-count * percentile // 100), 1) - 1
    width = np.sort(bits, axis=1)[np.arange(n), rank].astype(np.int64)
    out_row, out_at = np.nonzero(bits > width[:, None])
    outliers = np.bincount(out_row, minlength=n)
    size = HEAD.itemsize + width * (BLOCK // 8) + 5 * outliers
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    head = np.empty(n, dtype=HEAD)
    head["least"], head["outliers"], head["width"], head["last"] = least, outliers, width, count - 1
    out[start[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, HEAD.itemsize)
    for w in np.unique(width).tolist():
        if w:
            some = np.flatnonzero(width == w)
            planes = np.empty((len(some), BLOCK, w), dtype=np.uint8)
            low = rest[some]
            for b in range(w):
                planes[:, :, b] = (low >> np.uint32(b)) & np.uint32(1)
            packed = np.packbits(planes.reshape(len(some), -1), axis=1, bitorder="little")
            out[start[some][:, None] + HEAD.itemsize + np.arange(w * BLOCK // 8)] = packed
    nth = np.arange(len(out_row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    lists = start[out_row] + HEAD.itemsize + width[out_row] * (BLOCK // 8)
    out[lists + nth] = out_at
    high = (rest[out_row, out_at] >> width[out_row].astype(np.uint32)).astype("<u4")
    out[(lists + outliers[out_row] + 4 * nth)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return out.tobytes(), size


def unpack_blocks(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The values of the blocks that begin at ``start`` in ``data`` (bytes)."""
    parts = [_unpack(data, start[at:at + AT_ONCE]) for at in range(0, len(start), AT_ONCE)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)


def _unpack(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    n = len(start)
    head = np.ascontiguousarray(data[start[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(n)
    width, outliers = head["width"].astype(np.int64), head["outliers"].astype(np.int64)
    rest = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        if w:
            some = np.flatnonzero(width == w)
            packed = data[start[some][:, None] + HEAD.itemsize + np.arange(w * BLOCK // 8)]
            planes = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, w)
            low = np.zeros((len(some), BLOCK), dtype=np.uint32)
            for b in range(w):
                low |= planes[:, :, b].astype(np.uint32) << np.uint32(b)
            rest[some] = low
    row = np.repeat(np.arange(n), outliers)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    lists = start[row] + HEAD.itemsize + width[row] * (BLOCK // 8)
    high = np.ascontiguousarray(data[(lists + outliers[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rest[row, data[lists + nth]] |= high << width[row].astype(np.uint32)
    values = rest + head["least"][:, None]
    return values[np.arange(BLOCK) <= head["last"][:, None]]


class Writer:
    """Writes values to a binary stream as they come; the caller's own bytes go behind them."""

    def __init__(self, stream, percentile: int = PERCENTILE):
        self.stream, self.percentile = stream, percentile
        self.left, self.held, self.values, self.at = [], 0, 0, len(MAGIC)
        self.sizes: list[np.ndarray] = []
        stream.write(MAGIC)

    def add(self, values: np.ndarray) -> None:
        self.left.append(values)
        self.held += len(values)
        if self.held >= AT_ONCE * BLOCK:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, n: int) -> None:
        values = np.concatenate(self.left) if self.left else np.empty(0, np.uint32)
        data, sizes = pack_blocks(values[:n], self.percentile)
        self.stream.write(data)
        self.sizes.append(sizes)
        self.values += n
        self.at += len(data)
        self.left, self.held = [values[n:]], len(values) - n

    def close(self, own: bytes = b"") -> int:
        """Write what is left, index and trailer; the file's length."""
        self._flush(self.held)
        sizes = np.concatenate(self.sizes)
        start = len(MAGIC) + np.cumsum(sizes) - sizes
        index = start.astype("<u8").tobytes()
        tail = index + own
        self.stream.write(tail)
        self.stream.write(TRAILER.pack(self.values, len(sizes), self.at, self.at + len(index), len(own),
                                       zlib.crc32(tail), MAGIC))
        return self.at + len(tail) + TRAILER.size


class Reader:
    """Reads ranges of values from a seekable binary stream by the index of its blocks."""

    def __init__(self, stream, length: int):
        self.stream = stream
        self.values, n, at, own, n_own, crc, magic = TRAILER.unpack(self._bytes(length - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a file of patched blocks")
        tail = self._bytes(at, own + n_own - at)
        if zlib.crc32(tail) != crc:
            raise ValueError("the index of a file of patched blocks is damaged")
        self.start = np.append(np.frombuffer(tail, dtype="<u8", count=n).astype(np.int64), at)
        self.own = tail[own - at:]

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The values from ``start`` up to ``stop``; only their blocks are read."""
        if stop <= start:
            return np.empty(0, dtype=np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        begin = int(self.start[first])
        data = np.frombuffer(self._bytes(begin, int(self.start[last]) - begin), dtype=np.uint8)
        return unpack_blocks(data, self.start[first:last] - begin)[start - first * BLOCK:stop - first * BLOCK]
