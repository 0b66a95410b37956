"""Hashes of words and word shingles for whole Arrow text columns, inside tasks.

A word is a maximal run of bytes other than space and the five control characters 0x09-0x0D,
after A-Z are lower-cased. All words of a slice of texts are hashed at once: a cumulative sum
of byte * base**position gives each word's polynomial, divided by base**start (the base is odd,
so it has an inverse modulo 2**64) and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
"""Text worked on at once: a worker keeps what its largest slice took, some fifty times its bytes, for all later tasks."""

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, grown to the largest slice that a worker has met."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, SLICE_BYTES), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``size`` bytes of text; a longer text stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """Words of a slice of texts: bytes, where each word starts and ends, its hash, and per text the
    number of its first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    total: np.ndarray

    def beginnings(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of every word, 0 for shorter words."""
        stops = np.minimum(self.starts + size, self.ends)
        hashes = _close(self.total, self.starts, stops)
        hashes[self.ends - self.starts < size] = 0
        return hashes


def _close(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * _tables(len(total))[1][starts] + (ends - starts).astype(np.uint64) * _STEP)


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Words of texts given as bytes and offsets; ``space`` marks the bytes between words."""
    n = len(data)
    if not n:
        none, zero = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(data, none, none, zero, np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64))
    gap = space[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | first[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | first[1:])) + 1
    up, _ = _tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return Words(data, starts, ends, _close(total, starts, ends), np.searchsorted(starts, offsets).astype(np.int64), total)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and per text the offset of its first word (one more at the end)."""
    data, offsets = text_bytes(texts)
    found = split_words(LOWER[data], offsets)
    return found.hashes, found.offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; a shorter text is one shingle of all its words."""
    run = hashes.copy()
    if len(hashes) >= width:
        run = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            run = run * _STEP + hashes[k : len(hashes) - width + 1 + k]
        run = mix(run)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            value = np.uint64(b - a)
            for h in hashes[a:b]:
                value = mix(np.array([value * _STEP + h]))[0]
            out.append(np.array([value], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
