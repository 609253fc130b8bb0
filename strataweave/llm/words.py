"""Word and shingle hashes of whole Arrow text columns, computed with numpy on the column's own buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = np.array([0x20, 9, 10, 11, 12, 13])
_NONSPACE = np.ones(256, bool)
_NONSPACE[_SPACES] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(4095, _BASE)]))
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    if n <= len(_powers):
        return _powers
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))


class Words:
    """Words of every row: ``hashes`` (one per word), ``first`` (row i owns words first[i]:first[i+1]), byte spans."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        buf = column.buffers()[2]
        raw = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None else np.zeros(0, np.uint8)
        rows = offsets - offsets[0]
        raw = _LOWER[raw] if lower else raw
        solid = _NONSPACE[raw]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        cuts = rows[:-1][rows[:-1] < len(raw)]
        begins[cuts] |= solid[cuts]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | begins[1:]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        lengths = self.ends - self.starts
        self.rows, self.raw = rows, raw
        self.first = np.searchsorted(self.starts, rows)
        if len(lengths):
            at = np.concatenate([[0], np.cumsum(lengths)])
            within = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
            powers = _power_table(int(lengths.max()))
            total = np.add.reduceat(_BYTES[raw[solid]] * powers[within], at[:-1])
            self.hashes = mix64(total ^ (lengths.astype(np.uint64) * MIX_B))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.rows) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of ``k`` successive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP[0] + hashes[j : j + n]
    return mix64(out)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; fewer words than k: the whole sequence as one; none: empty."""
    if 0 < len(hashes) < k:
        return mix64(window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes)))
    return np.unique(window_hashes(hashes, k))
