"""Vectorised polynomial (Rabin-Karp) hashes of the words of a text.

All arithmetic is modulo 2**64. Words are hashed from their UTF-8 bytes, runs of
words from the word hashes, both through prefix sums, so a hash of any run costs
two look-ups. Long texts are hashed in pieces of BLOCK_BYTES, so the tables of
powers stay small. The bases are odd and therefore have inverses modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
#: Longer words are hashed by another function: some long strings made for it defeat polynomials modulo a power of two.
LONG_WORD_BYTES = 512
BLOCK_BYTES = 1 << 20
#: Words of a segment.
SEGMENT = 1 << 18

_BLANKS = [bytes([c]) for c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 15)
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)
        return self.up, self.down

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.full(size, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([1], _IS_BLANK[np.frombuffer(raw, np.uint8)].view(np.int8), [1])).astype(np.int8, copy=False))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in the bytes of a text."""
    starts, ends, at = [], [], 0
    for piece in pieces(raw):
        start, end = _bounds(piece)
        starts.append(start + at)
        ends.append(end + at)
        at += len(piece)
    return np.concatenate(starts), np.concatenate(ends)


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order."""
    return np.concatenate([_hashed(piece) for piece in pieces(raw)])


def pieces(raw: bytes) -> Iterator[bytes]:
    """Stretches of whole words, of at most BLOCK_BYTES unless a single word is longer."""
    at = 0
    while len(raw) - at > BLOCK_BYTES:
        end = max(raw.rfind(c, at, at + BLOCK_BYTES) for c in _BLANKS) + 1
        if end <= at:
            found = [x for x in (raw.find(c, at) for c in _BLANKS) if x >= 0]
            end = min(found) + 1 if found else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hashed(raw: bytes) -> np.ndarray:
    if len(raw) > BLOCK_BYTES:  # one word, with a blank behind it
        return np.array([xxhash.xxh3_64_intdigest(raw.strip(b"".join(_BLANKS)))], np.uint64)
    start, end = _bounds(raw)
    if not len(start):
        return np.empty(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    up, down = _BYTES.get(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD_BYTES):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h


class Rolling:
    """Hashes of runs of words."""

    def __init__(self, hashes: np.ndarray, seed: int = 0) -> None:
        self.n = len(hashes)
        up, self.down = _WORDS.get(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((mix(hashes, seed) if seed else hashes) * up[: self.n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` words."""
        if self.n < size:
            return np.empty(0, np.uint64)
        count = self.n - size + 1
        return mix((self.sums[size:] - self.sums[:count]) * self.down[:count])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each run from ``start`` up to ``end``."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def windows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words, made in segments."""
    parts = [Rolling(hashes[at : at + SEGMENT + size - 1]).windows(size) for at in range(0, max(len(hashes) - size + 1, 1), SEGMENT)]
    return np.concatenate(parts)


def sequence_hashes(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole sequence of words, as two signed integers."""
    raw = xxhash.xxh3_128_digest(np.ascontiguousarray(hashes).tobytes())
    return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)
