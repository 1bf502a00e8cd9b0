"""Vectorised text helpers shared by the operators: words, hashes, suffix order.

Everything works on the UTF-8 bytes of an Arrow string column as one flat
numpy buffer with document offsets, so no per-word Python object is made.
A null text is an empty byte range everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)

#: Byte maps: A-Z to a-z, and which bytes belong to words (bytes over 0x7F are parts of letters beyond ASCII).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):  # combine_chunks of no chunk
        texts = pa.array([], pa.string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8).copy()
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = buf[at[0] : at[-1]]
    return buf, at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[U64(1)], np.cumprod(np.full(max(n, 1), _MULT), dtype=U64)])[: max(n, 1)]


def spans(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in mask; a run never crosses one of cuts."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(mask))]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step: the work follows the number of ranges."""
    n = len(start)
    if not n:
        return np.zeros(0, U64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    h = size.astype(U64) * _MULT
    live = np.arange(n)
    step = 0
    while len(live):
        here = start[live] + step
        left = size[live] - step
        h[live] = mix(h[live] * U64(0xD6E8FEB86659FD93) + (at8[here] & _MASKS[np.minimum(left, 8)]))
        live = live[left > 8]
        step += 8
    return h


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = NOT_SPACE, lower: bool = True):
    """(start, end, document index, hash) of every word."""
    if lower:
        buf = LOWER[buf]
    start, end = spans(table[buf], offs)
    doc = np.searchsorted(offs, start, "right") - 1
    return start, end, doc, hash_spans(buf, start, end)


def counts_of(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many entries each of n documents has, and where its entries start."""
    c = np.bincount(doc, minlength=n).astype(np.int64)
    return c, np.cumsum(c) - c


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows with their documents; a document of fewer words, but not none, is one window."""
    n, at = counts_of(doc, n_docs)
    if not len(h):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    pw, total = powers(k + 1), np.concatenate([h, np.zeros(k, U64)])
    left = np.repeat(at + n, n) - np.arange(len(h))
    acc = np.zeros(len(h), U64)
    for j in range(k):
        acc += np.where(left > j, total[j : j + len(h)], U64(0)) * pw[j]
    keep = (left >= k) | ((np.repeat(n, n) < k) & (np.repeat(at, n) == np.arange(len(h))))
    return mix(acc + np.minimum(left, k).astype(U64))[keep], doc[keep]


def distinct_pairs(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, sorted within it, and the document offsets."""
    out, at = [], np.searchsorted(doc, np.arange(n_docs + 1))
    for i in range(n_docs):
        out.append(np.unique(h[at[i] : at[i + 1]]))
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def suffix_order(sym: np.ndarray, keep_levels: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks at each depth 1, 2, 4, ...

    sym must end each document with a symbol that occurs once, so that all
    suffixes differ and no comparison crosses a document's end. Only suffixes
    whose rank is still shared are sorted again; group, next rank and position
    go through one integer sort, since argsort is several times slower.
    """
    n = len(sym)
    if not n:
        return np.zeros(0, np.int64), []
    width = int(n).bit_length()
    low = (1 << width) - 1
    sa = np.sort((sym.astype(np.int64) << width) | np.arange(n, dtype=np.int64))
    head = np.concatenate([[True], (sa[1:] >> width) != (sa[:-1] >> width)])
    sa &= low
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, depth = [rank.copy()] if keep_levels else [], 1
    at = np.arange(n)
    while True:
        size = np.diff(np.append(np.flatnonzero(head), len(at)))
        open_ = np.repeat(size > 1, size)
        at, head = at[open_], head[open_]
        if not len(at):
            return sa, levels
        suf = sa[at]
        group = np.cumsum(head) - 1
        nxt = rank[np.minimum(suf + depth, n - 1)]
        if int(group[-1] + 1).bit_length() + 2 * width <= 63:
            key = np.sort((group << (2 * width)) | (nxt << width) | suf)
            suf = key & low
            key >>= width
        else:
            order = np.lexsort((suf, nxt, group))
            suf = suf[order]
            code = group * np.int64(n + 1) + nxt[order] if int(group[-1] + 1) * (n + 1) < 1 << 62 else None
            key = code if code is not None else np.cumsum(np.concatenate([[0], (np.diff(nxt[order]) != 0) | head[1:]]))
        sa[at] = suf
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suf] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        if keep_levels:
            levels.append(rank.copy())
        depth *= 2


def lcp_next(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix, in suffix order, with the one before it (0 at first)."""
    out = np.zeros(len(sa), np.int64)
    if len(sa) < 2:
        return out
    a, b = sa[:-1].copy(), sa[1:].copy()
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    got = np.zeros(len(live), np.int64)
    top = len(sa) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, top)] == levels[k][np.minimum(b, top)]
        step = same.astype(np.int64) << k
        got += step
        a += step
        b += step
    out[live + 1] = got
    return out


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on, and would keep what its largest block took."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20, max_rows: int = 60_000) -> Iterator[pa.Table]:
    """Regroups Arrow batches into tables of about max_bytes of text, at least one row each; memory stays bounded."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    pool = pa.default_memory_pool()
    for b in batches:
        at = 0
        while at < b.num_rows:
            room = max_bytes - size
            lens = np.diff(flat(b.column(b.schema.get_field_index(text)).slice(at))[1])
            take = int(np.searchsorted(np.cumsum(lens), room, "right"))
            take = min(take, max_rows - rows, b.num_rows - at)
            if take <= 0 and not rows:
                take = 1
            if take > 0:
                held.append(b.slice(at, take))
                size += int(lens[:take].sum())
                rows += take
                at += take
            if at < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
                pool.release_unused()
    if held:
        yield pa.Table.from_batches(held)
    held = []
    pool.release_unused()
    give_back()
