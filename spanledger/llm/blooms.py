"""Hashes that several documents hold, by two Bloom filters: one for hashes seen once, one for those seen twice.

A pass over the texts sends only 64-bit hashes, distinct in each batch, to segments of the hash space. A
segment (about SEGMENT_HASHES hashes, whatever the input) has two Bloom filters: a hash that the once filter
already holds goes into the twice filter. Hashes that the twice filter holds are suspects: all that are
held twice, and few others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, discard, gathered, mix64, slices, stash

SEGMENT_HASHES = 4_000_000
BROADCAST_BYTES = 128 << 20
_PROBES, BITS_EACH = 4, 16


class Bloom:
    """A Bloom filter over 64-bit hashes."""

    def __init__(self, expected: int):
        self.size = np.uint64(max(64, expected * BITS_EACH))
        self.bits = np.zeros(-(-int(self.size) // 8), dtype=np.uint8)

    def _at(self, h: np.ndarray):
        step = mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for i in range(_PROBES):
                yield (h + step * np.uint64(i)) % self.size

    def add(self, h: np.ndarray) -> None:
        for at in self._at(h):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8), dtype=np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for at in self._at(h):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def first_of_each(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each distinct pair of hash and row is first met, sorted by hash."""
    order = np.lexsort((rows, h))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return order[keep]


def _hashes(hashed: Callable, segments: int, piece: int):
    """Distinct hashes of each batch by segment; `often` are those found in two rows already."""

    def run(batches):
        for part in gathered(batches, limit=12 << 20):
            found = []
            for texts in slices([part], limit=piece):
                h, rows = hashed(texts.column("text"))
                found.append(h[first_of_each(h, rows)])
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0))
            segment = (h >> np.uint64(33)) % np.uint64(segments)
            order = np.argsort(segment, kind="stable")
            h, n, segment = h[order], n[order], segment[order]
            numbers = np.unique(segment)
            for s, a, b in zip(numbers.tolist(), np.searchsorted(segment, numbers), np.searchsorted(segment, numbers, side="right")):
                yield pa.record_batch([pa.array([s], pa.int32()), pa.array([h[a:b].tobytes()], pa.binary()), pa.array([h[a:b][n[a:b] > 1].tobytes()], pa.binary())], names=["segment", "seen", "often"])

    return run


def _suspects(batches):
    """Rows come sorted by segment. The suspects of each segment are those that its twice filter holds."""

    def close(seen: list[np.ndarray], often: list[np.ndarray]):
        once, twice = Bloom(sum(map(len, seen))), Bloom(sum(map(len, seen)))
        for h, more in zip(seen, often):
            twice.add(h[once.has(h)])
            twice.add(more)
            once.add(h)
        every = distinct(np.concatenate(seen))
        return pa.record_batch([pa.array(every[twice.has(every)].view(np.int64))], names=["hash"])

    now, seen, often = None, [], []
    for batch in batches:
        for segment, a, b in zip(batch.column("segment").to_pylist(), batch.column("seen"), batch.column("often")):
            if segment != now and seen:
                yield close(seen, often)
                seen, often = [], []
            now = segment
            seen.append(np.frombuffer(a.as_buffer(), dtype=np.uint64))
            often.append(np.frombuffer(b.as_buffer(), dtype=np.uint64))
    if seen:
        yield close(seen, often)


def repeated_hashes(texts: DataFrame, hashed: Callable, piece: int = SLICE_BYTES) -> DataFrame:
    """hash (long) of each hash that may be in two rows of texts(text); hashed(texts) gives hashes and their rows, of about `piece` bytes of text."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "segment int, seen binary, often binary"
    held = kept = stash(texts.select("text").mapInArrow(_hashes(hashed, partitions, piece), schema), compression="none")
    total = held.agg(F.coalesce(F.sum(F.length("seen")), F.lit(0))).first()[0] // 8
    if total > partitions * SEGMENT_HASHES:  # finer segments, so that each stays small
        partitions = -(-total // SEGMENT_HASHES)
        held = texts.select("text").mapInArrow(_hashes(hashed, partitions, piece), schema)
    found = stash(held.repartition(partitions, "segment").sortWithinPartitions("segment").mapInArrow(_suspects, "hash long"))
    discard(kept)
    return found


def as_filter(hashes: DataFrame, limit: int = BROADCAST_BYTES):
    """The hashes as a broadcast Bloom filter, or None if they are too many for one."""
    n = hashes.count()
    if n * max(8, BITS_EACH // 8) > limit:
        return None
    bloom = Bloom(n)
    bloom.add(np.array(hashes.toArrow().column(0).to_numpy(), dtype=np.int64).view(np.uint64))
    return hashes.sparkSession.sparkContext.broadcast(bloom)
