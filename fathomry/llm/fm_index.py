"""FM-index in numpy: suffix array, wavelet matrix ranks, backward search, sampled locate.

All searches are vectorised over the phrases, all locates over the occurrences.
"""

from __future__ import annotations

import numpy as np

from . import vec


class Ranks:
    """Bit vector with constant-time rank: 64-bit words and a running count for each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.zeros = n - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        w = i >> 6
        return self.base[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet matrix over symbols 0..sigma-1, most significant bit first."""

    def __init__(self, sym: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[Ranks] = []
        cur = sym
        for k in range(self.depth - 1, -1, -1):
            bit = ((cur >> k) & 1).astype(np.uint8)
            self.levels.append(Ranks(bit))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        # where each symbol's run begins in the last order
        self.start = np.zeros(sigma, np.int64)
        head = np.concatenate([[True], cur[1:] != cur[:-1]]) if len(cur) else np.zeros(0, bool)
        self.start[cur[head]] = np.flatnonzero(head)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs before position i."""
        for k, r in enumerate(self.levels):
            ones = r.ones(i)
            i = np.where((c >> (self.depth - 1 - k)) & 1, r.zeros + ones, i - ones)
        return i - self.start[c]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i, and how often it occurs before."""
        c = np.zeros(len(i), np.int64)
        for r in self.levels:
            bit, ones = r.get(i), r.ones(i)
            c = (c << 1) | bit
            i = np.where(bit, r.zeros + ones, i - ones)
        return c, i - self.start[c]


class FMIndex:
    """Over pieces of symbols 1..sigma-1, laid end to end; no phrase matches across two pieces.

    sym: the symbols; piece_end: ascending ends of the pieces in sym. Every
    sample-th text position and every piece's first one keeps its suffix position.
    """

    def __init__(self, sym: np.ndarray, piece_end: np.ndarray, sigma: int, sample: int = 16):
        m = len(piece_end)
        n = len(sym) + m
        self.shift = np.searchsorted(piece_end, np.arange(len(sym)), "right")  # separators before a symbol
        text = np.empty(n, np.int64)
        at = np.arange(len(sym)) + self.shift
        text[at] = sym + m - 1  # symbol 1 comes after the m separators
        ends = piece_end + np.arange(m)
        text[ends] = np.arange(m)
        self.origin = np.full(n, -1, np.int64)
        self.origin[at] = np.arange(len(sym))
        sa, _ = vec.suffix_order(text, keep_levels=False)
        before = np.where(sa > 0, text[sa - 1] - (m - 1), 0)
        bwt = np.maximum(before, 0)
        bwt[sa == 0] = 0
        self.wavelet = Wavelet(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(np.maximum(text - (m - 1), 0), minlength=sigma))])[:-1]
        starts = np.concatenate([[0], ends[:-1] + 1]) if m else np.zeros(0, np.int64)
        known = np.zeros(n, bool)
        known[::sample] = True
        known[starts] = True
        known[ends] = True
        self.known = Ranks(known[sa].astype(np.uint8))
        self.samples = sa[known[sa]]
        self.n = n

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases (a row each, padded with 0 at the right)."""
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        for step in range(int(size.max()) if len(size) else 0):
            live = np.flatnonzero((size > step) & (lo < hi))
            c = phrases[live, size[live] - 1 - step]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the given symbols where the suffixes of these rows begin."""
        rows = rows.copy()
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            hit = self.known.get(rows[live]) == 1
            done = live[hit]
            out[done] = self.samples[self.known.ones(rows[done])] + steps[done]
            live = live[~hit]
            c, r = self.wavelet.access_rank(rows[live])
            rows[live] = self.first[c] + r
            steps[live] += 1
        return self.origin[out]
