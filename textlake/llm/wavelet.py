"""A wavelet matrix over token ids: `width` bit-planes with rank directories, in one flat byte string.

Plane k holds bit width-1-k of each id, in the order that a stable partition by the planes above leaves (zeros first).
An id is read with one rank per plane; counting a value and finding its occurrences take one rank or select per plane.

Layout (little-endian): magic 'WM01', width u32, n u64, then for each plane: zeros u64, the ones before each block of
512 bits u32[], the bits, least bit of each byte first, padded to 8 bytes.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BLOCK = b"WM01", 512


def build(ids: np.ndarray, width: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype=np.uint16 if width <= 16 else np.uint32)
    out = [MAGIC, struct.pack("<IQ", width, len(ids))]
    for shift in range(width - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << shift)) != 0
        bits = np.packbits(ones, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)])
        blocks = np.add.reduceat(np.bitwise_count(bits.view("<u8")), np.arange(0, len(bits) // 8, BLOCK // 64), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(blocks, dtype=np.uint32)[:-1]]).astype("<u4") if len(bits) else blocks
        ids = np.concatenate([left := ids.take(np.flatnonzero(~ones)), ids.take(np.flatnonzero(ones))])
        out += [struct.pack("<Q", len(left)), before.tobytes(), bits.tobytes()]
    return b"".join(out)


class WaveletMatrix:
    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        self.width, self.n = struct.unpack_from("<IQ", data, 4)
        at, size = 16, (self.n + 63) // 64 * 8
        blocks = (size + BLOCK // 8 - 1) // (BLOCK // 8)
        self.zeros, self.before, self.planes = [], [], []
        for _ in range(self.width):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            self.before.append(np.frombuffer(data, "<u4", blocks, at + 8))
            at += 8 + 4 * blocks
            self.planes.append(np.frombuffer(data, np.uint8, size, at))
            at += size

    def _ones(self, level: int, i: int) -> int:
        """Set bits of a plane before position i."""
        block = i // BLOCK
        lo, (byte, bit) = block * BLOCK // 8, divmod(i, 8)
        plane = self.planes[level]
        total = int(self.before[level][block]) if block < len(self.before[level]) else self.n - self.zeros[level]
        if block < len(self.before[level]):
            total += int(np.bitwise_count(plane[lo:byte]).sum())
            if bit:
                total += (int(plane[byte]) & (1 << bit) - 1).bit_count()
        return total

    def _step(self, level: int, i: int, one: bool) -> int:
        ones = self._ones(level, i)
        return self.zeros[level] + ones if one else i - ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            one = bool(plane[i // 8] >> (i % 8) & 1)
            value = value << 1 | one
            i = self._step(level, i, one)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of `value` before position i stand below the last plane."""
        lo, hi = 0, i
        if value >> self.width:
            return 0, 0
        for level in range(self.width):
            one = bool(value >> (self.width - 1 - level) & 1)
            lo, hi = self._step(level, lo, one), self._step(level, hi, one)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of `value` before position i."""
        lo, hi = self._range(value, min(i, self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, k: int, one: bool) -> int:
        """Position of the k-th (from 0) bit of a plane with the given value."""
        before = self.before[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of `value`."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.width - 1, -1, -1):
            one = bool(value >> (self.width - 1 - level) & 1)
            i = self._select_bit(level, i - self.zeros[level] if one else i, one)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids in order, undoing the stable partitions from the last plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            zeros = self.zeros[level]
            above[np.flatnonzero(~ones)] = ids[:zeros]
            above[np.flatnonzero(ones)] = ids[zeros:] | kind(1 << (self.width - 1 - level))
            ids = above
        return ids
