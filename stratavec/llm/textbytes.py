"""Vectorised text kernels over the UTF-8 bytes of many documents at once.

Hashes are positional polynomials modulo 2**64 over a fixed random byte table, finished by an avalanche mix, so
any byte range costs O(1) after one cumulative sum. Equality of ranges is equality of these 64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_LOWER = BYTE[_LOWER]
MULTIPLIERS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one kernel call takes, unless a single document is longer.
SLICE_BYTES = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (SLICE_BYTES >> 1))
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text holds about `size` bytes; a longer document makes a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto


class Texts:
    """Documents laid end to end, each followed by one line feed, so that no word or line crosses documents."""

    def __init__(self, column: pa.Array):
        raw = [x if x is not None else b"" for x in pc.cast(column, pa.binary()).to_pylist()]
        self.n = len(raw)
        self.raw = raw
        self.buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def sums(self, lower: bool = False) -> "Spans":
        return Spans(self.buf, BYTE_LOWER if lower else BYTE)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all runs of characters other than ASCII white space."""
        gap = SPACE[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, self.doc_of(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the line-feed-split lines, empty ones included."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.concatenate(([0], ends[:-1] + 1))
        return starts, ends, self.doc_of(starts)


class Spans:
    """Constant-time hashes of byte ranges."""

    def __init__(self, buf: np.ndarray, table: np.ndarray):
        up, self.down = _power_tables(len(buf) + 1)
        self.total = np.empty(len(buf) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(table[buf] * up[: len(buf)], out=self.total[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * MULTIPLIERS[63])


def windows(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = word_hashes[:n] * MULTIPLIERS[0]
    for i in range(1, k):
        total = total + word_hashes[i : i + n] * MULTIPLIERS[i]
    return mix(total)


def counts_by(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(np.int64)
