"""Wavelet matrix files: one compressed file a shard of token ids.

Bit-plane by bit-plane from the most significant, ids are split stably by the plane's bit:
zeros first, then ones.  A file holds the document table and, for each plane, its
bits in blocks of 2**16 that are compressed one by one, with the number of ones before
each block (the rank directory) and each block's place.  So a token, a count or an occurrence
touches one or two blocks a plane, whatever the file's length.
"""

from __future__ import annotations

import io
import struct
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import zstandard

MAGIC = b"WVLTMTX1"
BLOCK_BITS = 1 << 16
#: Ids worked on at once while a file is made: whole blocks.
PIECE = 4 * BLOCK_BITS
_HEAD = struct.Struct("<8sQQI")


def write(out: BinaryIO, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> None:
    """Writes the file for the concatenated ids of documents with the given ids and lengths; ``ids`` is used as scratch.

    Two buffers of the ids' size take turns, and all else is done a piece at a time.
    """
    n, width = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
    pack = zstandard.ZstdCompressor(level=1)
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = pack.compress(np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + null.tobytes() + lengths.astype(np.int64).tobytes())
    out.write(_HEAD.pack(MAGIC, n, len(doc_ids), width) + struct.pack("<Q", len(table)) + table)
    cur, other = ids, np.empty_like(ids)
    for plane in range(width - 1, -1, -1):
        mask = ids.dtype.type(1 << plane)
        ones, packed = [0], []
        zero, one = 0, n - sum(int(np.count_nonzero(cur[at : at + PIECE] & mask)) for at in range(0, n, PIECE))
        for at in range(0, n, PIECE):
            piece = cur[at : at + PIECE]
            bit = (piece & mask) != 0
            low, high = np.compress(~bit, piece), np.compress(bit, piece)  # several times faster than indexing by such bits
            other[zero : zero + len(low)], other[one : one + len(high)] = low, high
            zero, one = zero + len(low), one + len(high)
            bits = np.packbits(bit, bitorder="little")
            for i in range(0, len(bits), BLOCK_BITS // 8):
                block = bits[i : i + BLOCK_BITS // 8]
                ones.append(ones[-1] + int(np.bitwise_count(block).sum(dtype=np.int64)))
                packed.append(pack.compress(block.tobytes()))
        out.write(np.array(ones, np.uint64).tobytes() + np.array([len(x) for x in packed], np.uint64).tobytes())
        for block in packed:
            out.write(block)
        cur, other = other, cur


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file as bytes; ``ids`` stay as they are."""
    out = io.BytesIO()
    write(out, np.array(ids, np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32), doc_ids, lengths)
    return out.getvalue()


class WaveletMatrix:
    """Reads a file made by ``build``."""

    def __init__(self, data: bytes):
        magic, self.n, self.docs, self.width = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self._data, self._unpack = data, zstandard.ZstdDecompressor()
        at = _HEAD.size
        (size,) = struct.unpack_from("<Q", data, at)
        table = self._unpack.decompress(data[at + 8 : at + 8 + size])
        ids = np.frombuffer(table, np.int64, self.docs)
        null = np.frombuffer(table, np.uint8, self.docs, 8 * self.docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.lengths = np.frombuffer(table, np.int64, self.docs, 9 * self.docs)
        at += 8 + size
        blocks = -(-((self.n + 7) // 8) // (BLOCK_BITS // 8))
        self._ones, self._places = [], []
        for _ in range(self.width):
            ones = np.frombuffer(data, np.uint64, blocks + 1, at).astype(np.int64)
            sizes = np.frombuffer(data, np.uint64, blocks, at + 8 * (blocks + 1)).astype(np.int64)
            at += 8 * (2 * blocks + 1)
            self._ones.append(ones)
            self._places.append(np.concatenate(([0], np.cumsum(sizes))) + at)
            at += int(sizes.sum())
        self._zeros = [self.n - int(o[-1]) for o in self._ones]
        self._block = lru_cache(256)(self._read_block)

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        a, b = self._places[plane][block : block + 2]
        return np.frombuffer(self._unpack.decompress(self._data[a:b]), np.uint8)

    def _rank1(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        ones = int(self._ones[plane][block])
        if rest:
            bits = self._block(plane, block)
            ones += int(np.bitwise_count(bits[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                ones += (int(bits[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return ones

    def _bit(self, plane: int, i: int) -> int:
        block, rest = divmod(i, BLOCK_BITS)
        return int(self._block(plane, block)[rest // 8]) >> (rest % 8) & 1

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        ones = self._ones[plane]
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(plane, block), bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The i-th token id."""
        value = 0
        for plane in range(self.width):
            bit = self._bit(plane, i)
            ones = self._rank1(plane, i)
            i = self._zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for plane in range(self.width):
            a, b = self._rank1(plane, lo), self._rank1(plane, hi)
            if token >> (self.width - 1 - plane) & 1:
                lo, hi = self._zeros[plane] + a, self._zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of a token among the first ``upto`` ids (all of them by default)."""
        if token >> self.width:
            return 0
        lo, hi = self._interval(token, self.n if upto is None else upto)
        return hi - lo

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._interval(token, self.n)[0] + k
        for plane in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - plane) & 1
            i = self._select(plane, bit, i - self._zeros[plane] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids (16 bits each if they fit), by undoing the splits from the last plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        cur, before = np.zeros(self.n, kind), np.empty(self.n, kind)
        for plane in range(self.width - 1, -1, -1):
            value, zero, one = kind(1 << (self.width - 1 - plane)), 0, self._zeros[plane]
            step = PIECE // BLOCK_BITS
            for first in range(0, len(self._ones[plane]) - 1, step):
                at = first * BLOCK_BITS
                packed = [self._read_block(plane, block) for block in range(first, min(first + step, len(self._ones[plane]) - 1))]
                bit = np.unpackbits(np.concatenate(packed), bitorder="little")[: self.n - at].view(bool)
                piece, ones, zeros = before[at : at + len(bit)], np.flatnonzero(bit), np.flatnonzero(~bit)
                # A one is the next of the ones, a zero the next of the zeros.
                piece[ones], piece[zeros] = cur[one : one + len(ones)] | value, cur[zero : zero + len(zeros)]
                zero, one = zero + len(zeros), one + len(ones)
            cur, before = before, cur
        return cur
