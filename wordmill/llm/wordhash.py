"""Hashes of words and of runs of words, for whole Arrow slices at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All sums are taken modulo 2**64
with odd bases, so that a prefix sum times a power of the inverse base gives the hash of
any part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_BACK = pow(_BYTE_BASE, -1, 1 << 64)
_BYTES = 1 << 19
_RUN_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, … (n of them)."""
    n = int(n)
    table = _tables.get(base)
    if table is None or len(table) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _tables[base] = table
    return table[:n]


def mixed(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


class Words:
    """The words of a slice of texts.

    ``starts`` and ``ends`` are byte places in ``data``; ``first`` has, for each text, the
    number of words before it, and the number of all words at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        self.data = _LOWER[raw] if lower else raw
        inside = ~_SPACE[raw]
        n = len(raw)
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < n)]  # a word ends where its text ends
        starts[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
        self.bounds = bounds
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        """One hash per word, in pieces of about ``_BYTES`` bytes so that the sums stay small."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + _BYTES, "right")))
            n = int(self.ends[j - 1] - low)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data[low : low + n].astype(np.uint64) + np.uint64(1)) * _powers(_BYTE_BASE, n), out=total[1:])
            starts = self.starts[i:j] - low
            out[i:j] = mixed((total[self.ends[i:j] - low] - total[starts]) * _powers(_BYTE_BACK, n + 1)[starts])
            i = j
        return out


def runs(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` words; entry i is the run that starts at word i."""
    n = max(len(words) - length + 1, 0)
    out = np.empty(n, dtype=np.uint64)
    base = _RUN_BASES[which]
    step = max(_BYTES, 4 * length)
    for at in range(0, n, step):
        here = words[at : min(at + step, n) + length - 1]
        total = np.zeros(len(here) + 1, dtype=np.uint64)
        np.cumsum(here * _powers(base, len(here)), out=total[1:])
        back = _powers(pow(base, -1, 1 << 64), len(here) - length + 1)
        out[at : at + step] = mixed((total[length:] - total[:-length]) * back + np.uint64(length))
    return out
