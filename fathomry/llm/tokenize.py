"""Token ids of byte-level BPE for whole columns, word by word.

The pre-tokenizer's pattern is laid over a block of text at once with numpy, each
distinct word is encoded once by the tokenizer and kept in a bounded cache, and the
ids are laid out by gathering. The ids are those of the tokenizers library over
the same vocabulary; a text is ordinary text even where it spells a special token.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from . import vec

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Words kept; beyond that the cache starts anew.
CACHE = 1 << 20


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The pattern's class of every code point: \\p{L}, \\p{N}, \\s or neither."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = code
    return out


def pretokens(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches over code points cp; texts begin at offs.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)  # a text begins
    first[offs[:-1]] = True
    first[n] = True
    first_at = first[:n]
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = change | first_at
    # white space before other text: its last character stands alone, or leads what follows if it is a blank
    space = kind == SPACE
    before_text = np.zeros(n, bool)
    before_text[:-1] = space[:-1] & ~space[1:] & ~first_at[1:]
    start |= before_text
    lead = before_text & (cp == 0x20)
    start[1:] &= ~lead[:-1]
    # contractions: an apostrophe that begins a match and stands before s, t, m, d, re, ve or ll
    q = np.flatnonzero((cp == 0x27) & start)
    q = q[q + 1 < n]
    q = q[(kind[q + 1] == LETTER) & ~first_at[q + 1]]
    if len(q):
        a = cp[q + 1]
        two = np.minimum(q + 2, n - 1)
        b = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], cp[two], 0)
        one_ = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
        pair = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        q, size = q[one_ | pair], np.where(one_, 2, 3)[one_ | pair]
        start[q + 1] = False
        after = q + size
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start)


class Encoder:
    """ids of whole texts with the vocabulary file at path (tokenizers' JSON)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.known = pd.Index(np.zeros(0, np.uint64))
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for y in got for x in y], np.uint32), np.array([len(y) for y in got], np.int64)

    def encode(self, texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        buf, offs = vec.flat(texts)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        point_at = np.flatnonzero((buf & 0xC0) != 0x80)  # byte of each code point
        cp_offs = np.searchsorted(point_at, offs)
        start = pretokens(cp, cp_offs)
        byte = point_at[start]
        end = np.append(byte[1:], len(buf))
        h = vec.hash_spans(buf, byte, end)
        code, uniq = pd.factorize(h)
        at = self.known.get_indexer(uniq)
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.known) + len(new) > CACHE:
            self.clear()
            new, at = np.arange(len(uniq)), np.full(len(uniq), -1)
        if len(new):
            where = np.full(len(uniq), -1, np.int64)
            seen = np.arange(len(code))[::-1]
            where[code[::-1]] = seen  # the first place of each word
            raw = buf.tobytes()
            ids, size = self._words([raw[byte[i] : end[i]].decode() for i in where[new].tolist()])
            at[new] = len(self.known) + np.arange(len(new))
            self.known = self.known.append(pd.Index(uniq[new]))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, ids])
        word = at[code]
        size = self.at[word + 1] - self.at[word]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[word] - total[:-1], size) + np.arange(int(total[-1]))]
        return ids, total[np.searchsorted(start, cp_offs)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
