"""Bloom filters of hashes that occur more than once, built side by side in segments of the hash space.

Every task sends the distinct hashes of its rows, sorted and cut into segments by their top bits. A
segment is bounded by the number of hashes that the caller expects, so more data make more segments,
not larger ones. Whoever gets a segment keeps a once-seen and a twice-seen filter of it, or sums
exact counts. What is broadcast are the filters of repeated hashes only, sized by their number; beyond
``most_bytes`` they are folded to half their size as often as needed. A fuller filter only raises the
share of false suspects, which the callers confirm exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch
from .words import mix64

_SECOND = np.uint64(0x5851F42D4C957F2D)
_IN_SEGMENT = 1 << 16
_BITS_EACH = 8


def expected_units(df: DataFrame, text_col: str, chars: float) -> float:
    """How many parts of about ``chars`` characters the texts hold; only sizes follow from it."""
    return (df.agg(F.sum(F.length(text_col))).first()[0] or 0) / chars


def segments_for(expected: float, each: int = _IN_SEGMENT) -> int:
    """The number of top bits that name a segment."""
    return int(min(20, max(0, np.ceil(np.log2(max(1.0, expected / each))))))


def segment_of(h: np.ndarray, log_segments: int) -> np.ndarray:
    return (h >> np.uint64(64 - log_segments)).astype(np.int64) if log_segments else np.zeros(len(h), np.int64)


def summed(parts: Iterator[np.ndarray], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted values and their counts, combined over about ``most`` values at a time."""
    held: list[np.ndarray] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= most:
            yield np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)


def positions(h: np.ndarray, log_bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash among 2**log_bits bits; halving the bits drops the highest bit of a place."""
    mask = (np.uint64(1) << np.asarray(log_bits).astype(np.uint64)) - np.uint64(1)
    return mix64(h) & mask, mix64(h ^ _SECOND) & mask


def put(bits: np.ndarray, at: np.ndarray) -> None:
    """Set bits; positions may repeat."""
    if len(at):
        at = np.unique(at)
        byte, first = np.unique(at >> np.uint64(3), return_index=True)
        bits[byte] |= np.bitwise_or.reduceat(np.uint8(1) << (at & np.uint64(7)).astype(np.uint8), first)


def held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


class Filter:
    """The filters of all segments, one after the other, each with its own power of two of bits."""

    def __init__(self, log_segments: int, logs: np.ndarray, starts: np.ndarray, bits: np.ndarray):
        self.log_segments, self.logs, self.starts, self.bits = log_segments, logs, starts, bits

    def has(self, h: np.ndarray) -> np.ndarray:
        seg = segment_of(h, self.log_segments)
        start, out = self.starts[seg].astype(np.uint64) << np.uint64(3), np.ones(len(h), bool)
        for at in positions(h, self.logs[seg]):
            out &= held(self.bits, start + at)
        return out


def packed(h: np.ndarray) -> tuple[int, bytes]:
    """A filter of distinct hashes of one segment: log2 of its bits, and these."""
    log_bits = max(3, int(np.ceil(np.log2(max(1, _BITS_EACH * len(h))))))
    bits = np.zeros((1 << log_bits) // 8, np.uint8)
    for at in positions(h, log_bits):
        put(bits, at)
    return log_bits, bits.tobytes()


def folded(bits: np.ndarray, log_bits: int, to: int) -> np.ndarray:
    while log_bits > max(3, to):
        half = len(bits) // 2
        bits, log_bits = bits[:half] | bits[half:], log_bits - 1
    return bits


def slices(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], log_segments: int) -> DataFrame:
    """(seg, h, n): sorted distinct hashes of some rows in one segment, and how often these rows hold each."""
    edges = (np.arange(1, 1 << log_segments).astype(np.uint64) << np.uint64(64 - log_segments)) if log_segments else np.zeros(0, np.uint64)

    def cut(batches):
        for h, n in summed(x for b in batches for x in hashes(b)):
            at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]]).astype(np.int32)
            some = np.flatnonzero(np.diff(at))
            ends = pa.array(np.append(at[some], len(h)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(np.minimum(n, 2**31 - 1).astype(np.int32)))], names=["seg", "h", "n"])

    return df.mapInArrow(cut, "seg int, h array<long>, n array<int>").repartition("seg")


def _rows(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].as_py(), b.column(1)[k].values.to_numpy().view(np.uint64), b.column(2)[k].values.to_numpy()


def gathered(parts: DataFrame, log_segments: int, most_bytes: int) -> Filter:
    """Collect (seg, log_bits, bits), folded so that all are no more than ``most_bytes``, but a byte a segment."""
    parts = scratch(parts, "filter")
    sizes = lambda fold: parts.agg(F.sum(F.expr(f"shiftleft(1L, greatest(0, log_bits - 3 - {fold}))"))).first()[0] or 0
    fold = next(k for k in range(64) if k == 63 or sizes(k) <= max(most_bytes, 1 << log_segments))

    def fold_all(batches):
        for b in batches:
            logs = b.column(1).to_numpy().astype(np.int64)
            new = np.maximum(np.minimum(logs, 3), logs - fold)
            bits = [folded(np.frombuffer(x.as_buffer(), np.uint8), int(o), int(t)).tobytes() for x, o, t in zip(b.column(2), logs, new, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new.astype(np.int32)), pa.array(bits, pa.binary())], names=["seg", "log_bits", "bits"])

    logs, blobs = np.full(1 << log_segments, 3, np.int8), {}
    for row in (parts.mapInArrow(fold_all, "seg int, log_bits int, bits binary") if fold else parts).toLocalIterator():
        logs[row.seg], blobs[row.seg] = row.log_bits, row.bits
    size = (1 << logs.astype(np.int64)) // 8
    starts = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), np.uint8)
    for seg in list(blobs):
        bits[starts[seg] : starts[seg] + size[seg]] = np.frombuffer(blobs.pop(seg), np.uint8)
    return Filter(log_segments, logs, starts, bits)


def seen_twice(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: float, most_bytes: int = 1 << 28) -> Filter:
    """A filter of all hashes that occur twice or more in ``df``, by a once-seen and a twice-seen Bloom
    filter for every segment; it may hold a few others."""
    log_segments = segments_for(expected)
    log_once = int(np.ceil(np.log2(max(64.0, 16 * expected / (1 << log_segments)))))

    def merge(batches):
        own: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for seg, h, n in _rows(batches):
            once, twice = own.setdefault(seg, (np.zeros((1 << log_once) // 8, np.uint8), []))
            first, second = positions(h, log_once)
            twice.append(h[(n > 1) | (held(once, first) & held(once, second))])
            put(once, first)
            put(once, second)
        for seg, (_, twice) in own.items():
            if sum(map(len, twice)):
                log_bits, bits = packed(np.unique(np.concatenate(twice)))
                yield pa.RecordBatch.from_pydict({"seg": pa.array([seg], pa.int32()), "log_bits": pa.array([log_bits], pa.int32()), "bits": pa.array([bits], pa.binary())})

    return gathered(slices(df, hashes, log_segments).mapInArrow(merge, "seg int, log_bits int, bits binary"), log_segments, most_bytes)


def seen_often(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: float, levels: tuple[int, ...], most_bytes: int = 1 << 28) -> list[Filter]:
    """For each level a filter of the hashes that occur that often in ``df``, by exact counts."""
    log_segments = segments_for(expected)

    def merge(batches):
        own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for seg, h, n in _rows(batches):
            own.setdefault(seg, []).append((h, n))
        for seg in list(own):
            parts = own.pop(seg)
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            h, n = h[at], np.add.reduceat(n.astype(np.int64), at)
            for level, least in enumerate(levels):
                if (n >= least).any():
                    log_bits, bits = packed(h[n >= least])
                    yield pa.RecordBatch.from_pydict({"level": pa.array([level], pa.int32()), "seg": pa.array([seg], pa.int32()), "log_bits": pa.array([log_bits], pa.int32()), "bits": pa.array([bits], pa.binary())})

    merged = scratch(slices(df, hashes, log_segments).mapInArrow(merge, "level int, seg int, log_bits int, bits binary"), "levels")
    return [gathered(merged.where(F.col("level") == k).drop("level"), log_segments, most_bytes) for k in range(len(levels))]


def filter_of(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], expected: float, most_bytes: int = 1 << 28) -> Filter:
    """A filter of all hashes of ``df``."""
    return seen_often(df, hashes, expected, (1,), most_bytes)[0]
