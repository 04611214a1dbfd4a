"""Elias-Fano codes of rising numbers, with samples for selection."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many numbers the place of one is kept, from which others are reached.
SAMPLE = 256
#: Numbers, bytes of the high bits, low bits of each, bytes of the low bits and of the samples.
_HEAD = "<QQBQQ"


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: np.ndarray, start: int, count: int, bits: int) -> np.ndarray:
    """Numbers start to start + count of `bits` bits each."""
    if not bits or not count:
        return np.zeros(count, dtype=np.uint64)
    first = start * bits
    raw = np.unpackbits(data[first // 8 : (first + count * bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + count * bits]
    return (raw.reshape(count, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def encode(values: np.ndarray) -> bytes:
    """Bytes for rising numbers (equal ones allowed) from 0."""
    values = np.asarray(values, dtype=np.uint64)
    count, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // count).bit_length() - 1) if count else 0
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(count)
    ones = np.zeros(int(high[-1]) + 1 if count else 0, dtype=np.uint8)
    ones[high] = 1
    lows = _pack(values & np.uint64((1 << low) - 1), low)
    highs = np.packbits(ones, bitorder="little").tobytes()
    samples = high[::SAMPLE].astype("<u8" if len(highs) >= 1 << 29 else "<u4").tobytes()
    return struct.pack(_HEAD, count, len(highs), low, len(lows), len(samples)) + lows + samples + highs


class EliasFano:
    """Reads a code made by encode()."""

    def __init__(self, data: bytes, at: int = 0):
        self.count, n_high, self.low, n_low, n_samples = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        whole = np.frombuffer(data, dtype=np.uint8)
        self.lows = whole[at : at + n_low]
        self.samples = np.frombuffer(data, dtype="<u8" if n_high >= 1 << 29 else "<u4", count=n_samples // (8 if n_high >= 1 << 29 else 4), offset=at + n_low)
        self.highs = whole[at + n_low + n_samples : at + n_low + n_samples + n_high]
        self.end = at + n_low + n_samples + n_high

    def __len__(self) -> int:
        return self.count

    def select(self, number: int) -> int:
        """The value at a place, without reading the others."""
        if not 0 <= number < self.count:
            raise IndexError(number)
        place = int(self.samples[number // SAMPLE])
        left = number % SAMPLE
        while left:  # on to the one that is `left` further
            byte = (place + 1) // 8
            part = self.highs[byte : byte + 64]
            ones = np.flatnonzero(np.unpackbits(part, bitorder="little"))
            ones = ones[ones >= (place + 1) - 8 * byte]
            taken = min(left, len(ones))
            left -= taken
            place = 8 * byte + (int(ones[taken - 1]) if left == 0 else 8 * len(part) - 1)
        return ((place - number) << self.low) | int(_unpack(self.lows, number, 1, self.low)[0])

    def selected(self, start: int, stop: int) -> np.ndarray:
        """The values at places start to stop, read from the sample before them on."""
        stop = min(stop, self.count)
        if start >= stop:
            return np.zeros(0, dtype=np.uint64)
        first = start // SAMPLE
        byte = int(self.samples[first]) // 8
        last = int(self.samples[(stop - 1) // SAMPLE + 1]) // 8 + 1 if (stop - 1) // SAMPLE + 1 < len(self.samples) else len(self.highs)
        ones = np.flatnonzero(np.unpackbits(self.highs[byte:last], bitorder="little")) + 8 * byte
        ones = ones[np.searchsorted(ones, int(self.samples[first])) :][start - first * SAMPLE : stop - first * SAMPLE]
        return ((ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low)) | _unpack(self.lows, start, stop - start, self.low)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.count]
        high = (ones - np.arange(self.count)).astype(np.uint64)
        return (high << np.uint64(self.low)) | _unpack(self.lows, 0, self.count, self.low)
