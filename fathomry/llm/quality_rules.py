"""Suffix-array repetition rules.

A suffix array over the words of each text gives, with the longest common
prefixes of neighbouring suffixes, the maximal repeated substrings: a repeat is
maximal when the word before it differs too, i.e. when the longest repeat that
starts one word earlier isn't just one longer. The union of their spans and the
longest one are limited, beside plain length and 5-word-window rules.

Every word under a repeat of ``min_repeat`` words is in a repeated window too, and a
repeat whose copies don't overlap covers twice its length. So the limits on repeats
are below the base's 20 % (for the longest one: below half of what they may cover),
or they could drop nothing that the base keeps.

Documents are handled in blocks of a few MB inside ``mapInArrow``: no shuffle,
memory bounded by a block (or one longer text), lost tasks are simply rerun.

Defined results: a null or empty text, or one of white space, has no words, all
counts 0, fails the base rule and isn't kept; repeated rows give repeated rows;
an empty table gives no rows; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vec
from .common import small_batches

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, n_maximal long, longest_repeat long, kept boolean"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Limits:
    window: int = 5  # words in a base window
    min_words: int = 10
    max_repeat_percent: int = 20  # of words in repeated windows
    min_repeat: int = 8  # words of a maximal repeat that counts
    max_covered: float = 0.12  # share of words under maximal repeats
    max_longest: float = 0.05  # longest repeat as a share of the words
    max_symbols: float = 0.1  # symbols a word
    max_dup_lines: float = 0.3  # of the lines with a word, where more than two are repeats


def repetition(h: np.ndarray, doc: np.ndarray, n_docs: int, window: int, min_repeat: int) -> dict[str, np.ndarray]:
    """Per document: words in repeated windows, words under maximal repeats, number and length of those."""
    n, at = vec.counts_of(doc, n_docs)
    zero = np.zeros(n_docs, np.int64)
    if not len(h):
        return dict(window_words=zero, covered=zero, n_maximal=zero, longest=zero)
    import pandas as pd

    code, uniq = pd.factorize(h)
    # a word's symbol holds its document, so suffixes of different documents never share a prefix
    sym = np.empty(len(h) + n_docs, np.int64)
    pos = np.arange(len(h)) + doc
    sym[pos] = doc * np.int64(len(uniq) + 1) + code + 1
    sym[at + n + np.arange(n_docs)] = np.arange(n_docs) * np.int64(len(uniq) + 1)
    if int(sym.max()).bit_length() + int(len(sym)).bit_length() > 62:
        sym = np.unique(sym, return_inverse=True)[1].astype(np.int64)
    sa, levels = vec.suffix_order(sym)
    lcp = vec.lcp_next(sa, levels)
    del levels
    both = np.maximum(lcp, np.append(lcp[1:], 0))
    longest_at = np.zeros(len(sym), np.int64)  # longest repeat that starts here
    longest_at[sa] = both
    owner = np.zeros(len(sym), np.int64)
    owner[pos] = doc
    owner[at + n + np.arange(n_docs)] = np.arange(n_docs)

    def covered(least: int, span: np.ndarray) -> np.ndarray:
        reach = np.maximum.accumulate(np.where(span >= least, np.arange(len(sym)) + span, 0))
        return np.bincount(owner[np.arange(len(sym)) < reach], minlength=n_docs).astype(np.int64)

    before = np.concatenate([[0], longest_at[:-1]])
    maximal = (longest_at >= min_repeat) & (before != longest_at + 1)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, owner[longest_at > 0], longest_at[longest_at > 0])
    return dict(
        window_words=covered(window, np.where(longest_at >= window, window, 0)),
        covered=covered(min_repeat, np.where(maximal, longest_at, 0)),
        n_maximal=np.bincount(owner[maximal], minlength=n_docs).astype(np.int64),
        longest=longest,
    )


def line_repeats(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and how many of them equal an earlier line."""
    import pandas as pd

    n_docs = len(offs) - 1
    start, end = vec.spans(buf != 10, offs)
    with_word = np.add.reduceat(is_word.astype(np.int64), start) > 0 if len(start) else np.zeros(0, bool)
    # reduceat runs to the next start; between two lines lie only line ends, which are no word bytes
    start, end = start[with_word], end[with_word]
    doc = np.searchsorted(offs, start, "right") - 1
    h = vec.hash_spans(buf, start, end)
    lines = np.bincount(doc, minlength=n_docs).astype(np.int64)
    code = pd.factorize(vec.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[0] if len(h) else np.zeros(0, np.int64)
    first = ~pd.Series(code).duplicated().to_numpy()
    return lines, lines - np.bincount(doc[first], minlength=n_docs).astype(np.int64)


def _per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def measure(ids: pa.Array, texts: pa.Array, limits: Limits) -> pa.RecordBatch:
    buf, offs = vec.flat(texts)
    n_docs = len(offs) - 1
    is_word = vec.NOT_SPACE[buf]
    start, end, doc, h = vec.words(buf, offs, lower=False)
    n = np.bincount(doc, minlength=n_docs).astype(np.int64)
    chars = _per_doc(is_word & ((buf & 0xC0) != 0x80), offs)
    symbols = _per_doc(_SYMBOL[buf], offs)
    lines, dup_lines = line_repeats(buf, offs, is_word)
    r = repetition(h, doc, n_docs, limits.window, limits.min_repeat)
    failed = (n < limits.min_words) | (100 * r["window_words"] > limits.max_repeat_percent * n)
    bad = (r["covered"] > limits.max_covered * n) | (r["longest"] > np.maximum(limits.max_longest * n, 2 * limits.min_repeat))
    bad |= (symbols > limits.max_symbols * n) | ((dup_lines > limits.max_dup_lines * lines) & (dup_lines > 2))
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), *(pa.array(x) for x in (n, chars, symbols, dup_lines, r["window_words"], failed, r["covered"], r["n_maximal"], r["longest"], ~(failed | bad)))],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row per row of docs (doc_id, text): the counts, base_failed and kept."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=2 << 20):
            yield measure(t["doc_id"].combine_chunks(), t["text"], limits)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
