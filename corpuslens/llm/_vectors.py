"""Words, tokens and byte n-grams of many texts at once, with numpy on the texts' bytes.

Hashes are 64-bit polynomials modulo 2**64 taken from prefix sums, mixed at the end; they're the same in every process.
Where a hash decides a result, a second one with other constants is compared as well."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """The first powers of ``base``; of each base only the longest array asked for is held."""
    held = _POWERS.get(base)
    if held is None or len(held) < size:
        held = np.ones(max(1 << 16, size), np.uint64)
        done = 1
        while done < len(held):
            n = min(done, len(held) - done)
            held[done : done + n] = held[:n] * _U(pow(base, done, 1 << 64))
            done += n
        _POWERS[base] = held
    return held[:size]


@lru_cache(maxsize=4)
def _byte_values(lane: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASES[lane]))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[starts])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of stretches of bytes."""
    return _spans(_byte_values(lane)[data], starts, ends, _BASES[lane])


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each ``width`` consecutive bytes, those of ``span_hashes``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(0)[data] * powers(_BASES[0], len(data)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(_BASES[0], -1, 1 << 64), len(data) + 1)[: len(data) + 1 - width])


class Texts:
    """Bytes of some texts, one after another, without a gap: ``bounds[i]:bounds[i + 1]`` are those of text i."""

    def __init__(self, column: pa.Array, lower: bool = False):
        parts = [(x or "").encode() for x in column.to_pylist()]
        self.bounds = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=self.bounds[1:])
        raw = b"".join(parts)
        self.data = np.frombuffer(raw.lower() if lower else raw, np.uint8)  # of bytes, lower() changes A to Z alone

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number) of every maximal run without white space."""
        ink = ~WHITE[self.data]
        before, after = np.ones(len(ink), bool), np.ones(len(ink), bool)
        before[1:] = ~ink[:-1]
        after[:-1] = ~ink[1:]
        inner = self.bounds[1:-1]
        before[inner[inner < len(ink)]] = True
        after[inner[inner > 0] - 1] = True
        starts = np.flatnonzero(ink & before)
        return starts, np.flatnonzero(ink & after) + 1, np.searchsorted(self.bounds, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        return span_hashes(self.data, starts, ends, lane)


def rolled(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A hash of each ``width`` consecutive values; empty where there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return _spans(hashes, at, at + width, _BASES[(lane + 2) % 4])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values
