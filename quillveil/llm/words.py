"""Vectorised 64-bit word hashes over the bytes of many texts at once.

Short words are hashed as polynomials modulo 2^64 of random byte values. In such a hash long structured words
collide whatever the base (those of Thue and Morse), so words of more than 64 bytes are hashed by xxh3.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_OTHER_BASE = 0xC2B2AE3D27D4EB4F
_SPAN = 1 << 20
_LONG = 64
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_VALUE_OTHER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xAF251AF3B0F025B5))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers[name]


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word."""
    n = len(buf)
    inside = np.empty(n + 1, bool)
    inside[n] = False
    np.logical_not(_SPACE[buf], out=inside[:n])
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    after = np.empty(n + 1, bool)
    after[0] = False
    after[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~after | edge))
    ends = np.flatnonzero(after & (~inside | edge))
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and each text's first word (one more entry than texts)."""
    starts, ends, first = word_spans(buf, bounds)
    return span_hashes(buf, starts, ends, _VALUE_LOWER if lower else _VALUE), starts, ends, first


def other_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second hash of the same spans, independent of ``word_hashes`` without lower-casing."""
    return span_hashes(buf, starts, ends, _VALUE_OTHER, _OTHER_BASE)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = _VALUE, base: int = _BASE) -> np.ndarray:
    """Hashes of byte spans that follow one another and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, side="right")))
        at, to = starts[i], ends[j - 1]
        length = max(_SPAN, int(to - at)) + 1
        up, down = _power(f"up {base}", base, length), _power(f"down {base}", pow(base, -1, 1 << 64), length)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(value[buf[at:to]] * up[: to - at], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    seed = base & 0xFFFFFFFF
    for k in np.flatnonzero(ends - starts > _LONG):
        span = buf[starts[k] : ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(span.translate(_LOW) if value is _VALUE_LOWER else span, seed)
    return out


def overlapping_hashes(buf: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the spans of ``n`` bytes from ``starts`` on, which may overlap, equal to those of ``span_hashes``."""
    length = max(_SPAN, len(buf)) + 1
    up, down = _power(f"up {_BASE}", _BASE, length), _power(f"down {_BASE}", pow(_BASE, -1, 1 << 64), length)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * up[: len(buf)], out=sums[1:])
    out = mix64((sums[starts + n] - sums[starts]) * down[starts] + np.uint64(n))
    if n > _LONG:
        for k, s in enumerate(starts):
            out[k] = xxhash.xxh3_64_intdigest(buf[s : s + n].tobytes(), _BASE & 0xFFFFFFFF)
    return out
