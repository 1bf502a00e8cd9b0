"""Quality by a weak-label model.

Heuristic labellers look at a whole text and vote good (1), bad (-1) or nothing (0); they
overlap and contradict each other. Expectation-maximisation estimates how often each votes what
for good and for bad texts, and so the posterior of every pattern of votes; all documents
count, as patterns and how often they occur (3 ** labellers numbers at most go to the driver).
A hashed linear scorer is then trained on posteriors as soft labels: its features are hashed
word shapes and the values the labellers look at, in bins, and it decides what is kept.

The scorer fits at most ``max_rows`` texts, those with the smallest hashes of (doc_id,
text). Everything else is narrow; a model is ``dimension`` numbers.

Defined results: a null or empty text has no words and is voted bad for its length; a
text's copies get equal results; repeated rows give repeated rows; an empty table
gives no rows; if all posteriors agree the scorer is constant; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import sample as sample_of, small_batches
from .common import stored

SCHEMA = "doc_id long, votes array<int>, posterior double, score double, kept boolean"


@dataclass(frozen=True)
class Options:
    max_rows: int = 6000
    dimension: int = 1 << 14
    rounds: int = 100
    steps: int = 200
    rate: float = 0.05
    decay: float = 1e-4
    cut: float = 0.5


#: (name, bad from, good up to): a value of at least the first votes bad, of at most the second good.
LABELLERS = [
    ("symbols", 0.10, 0.02),  # of #*$%&|<> per word
    ("symbol_bytes", 0.05, 0.01),  # the same, per byte of the words
    ("symbol_words", 0.20, 0.03),  # words that hold one
    ("shouting", 0.30, 0.10),  # upper-case ASCII letters per letter
    ("exclamation", 0.20, 0.02),  # ! per word
    ("adjacent", 0.10, 0.01),  # words equal to the one before
    ("repeated_trigrams", 0.25, 0.05),  # three-word windows seen before
    ("repeated_lines", 0.30, 0.0),  # lines equal to an earlier one
    ("unstopped_lines", 0.60, 0.35),  # lines without . ! ? or : at their end
    ("digits", 0.20, 0.05),  # of the characters
    ("short", 1 / 12, 1 / 40),  # one through the number of words
    ("odd_length", 3.5, 2.5),  # distance of the mean word length from 5.5 bytes
]


def values(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """What each labeller looks at: a row per document."""
    n_docs = len(offs) - 1
    start, end, doc, h = vec.words(buf, offs, lower=False)
    n = np.bincount(doc, minlength=n_docs)
    some = np.maximum(n, 1)

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[offs[1:]] - c[offs[:-1]]

    upper = (buf >= 65) & (buf <= 90)
    letters = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 0x80)
    same_doc = doc[1:] == doc[:-1]
    adjacent = np.bincount(doc[1:][same_doc & (h[1:] == h[:-1])], minlength=n_docs)
    tri, tri_doc = vec.shingles(h, doc, n_docs, 3)
    repeat = pd.Series(vec.mix(tri + tri_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated().to_numpy()
    tri_n = np.maximum(np.bincount(tri_doc, minlength=n_docs), 1)
    a, b = vec.spans(buf != 10, offs)
    full = np.add.reduceat(vec.NOT_SPACE[buf].astype(np.int64), a) > 0 if len(a) else np.zeros(0, bool)
    a, b = a[full], b[full]
    own = np.searchsorted(offs, a, "right") - 1
    line_h = vec.hash_spans(buf, a, b)
    again = pd.Series(vec.mix(line_h + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated().to_numpy()
    open_ = ~np.isin(buf[b - 1], list(b".!?:")) if len(b) else np.zeros(0, bool)
    lines = np.maximum(np.bincount(own, minlength=n_docs), 1)
    word_bytes = total(vec.NOT_SPACE[buf])
    symbol = np.isin(buf, list(b"#*$%&|<>"))
    upto = np.concatenate([[0], np.cumsum(symbol)])
    return np.stack([
        total(symbol) / some,
        total(symbol) / np.maximum(word_bytes, 1),
        np.bincount(doc[upto[end] > upto[start]], minlength=n_docs) / some,
        total(upper) / np.maximum(total(letters), 1),
        total(buf == 0x21) / some,
        adjacent / some,
        np.bincount(tri_doc[repeat], minlength=n_docs) / tri_n,
        np.bincount(own[again], minlength=n_docs) / lines,
        np.bincount(own[open_], minlength=n_docs) / lines,
        total((buf >= 48) & (buf <= 57)) / np.maximum(word_bytes, 1),
        np.where(n > 0, 1 / some, 1.0),
        np.abs(word_bytes / some - 5.5),
    ], 1)


def votes(v: np.ndarray) -> np.ndarray:
    bad, good = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))
    return np.where(v >= bad, -1, np.where(v <= good, 1, 0)).astype(np.int64)


def pattern(vote: np.ndarray) -> np.ndarray:
    return ((vote + 1) * 3 ** np.arange(vote.shape[1])).sum(1)


def expectation_maximisation(codes: np.ndarray, count: np.ndarray, labellers: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, log odds of each vote: labeller x (bad, none, good)).

    Starts from the bad votes, one of which may be chance and two are not: so the class
    that is found is theirs, whatever the many votes for good agree on.
    """
    v = (codes[:, None] // 3 ** np.arange(labellers)) % 3
    p = 1 / (1 + np.exp(4.0 * ((v == 0).sum(1) - 1.5)))
    odds = np.zeros((labellers, 3))
    for _ in range(rounds if len(codes) else 0):
        good, bad = count * p, count * (1 - p)
        for j in range(labellers):
            a = np.bincount(v[:, j], weights=good, minlength=3) + 1
            b = np.bincount(v[:, j], weights=bad, minlength=3) + 1
            odds[j] = np.log(a / a.sum()) - np.log(b / b.sum())
        prior = np.log((good.sum() + 1) / (bad.sum() + 1))
        new = 1 / (1 + np.exp(-np.clip(prior + odds[np.arange(labellers), v].sum(1), -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, odds


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[0x80:] = 97


def features(buf: np.ndarray, offs: np.ndarray, v: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hashed feature, weight): shares of word endings' shapes, and each value's bin."""
    n_docs = len(offs) - 1
    shape = _SHAPE[buf]
    start, end, doc, _ = vec.words(shape, offs, lower=False)
    h = vec.hash_spans(shape, np.maximum(start, end - 3), end)
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    pair, c = np.unique(doc * np.int64(dimension) + (h % np.uint64(dimension)).astype(np.int64), return_counts=True)
    d, f = pair // dimension, pair % dimension
    bad, good = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))
    bins = np.clip(np.floor((v - good) / np.maximum(bad - good, 1e-9) * 3) + 1, 0, 5).astype(np.uint64)
    b = vec.mix(np.arange(len(LABELLERS), dtype=np.uint64) * np.uint64(64) + bins + np.uint64(1 << 40))
    return np.concatenate([d, np.repeat(np.arange(n_docs), len(LABELLERS))]), np.concatenate([f, (b % np.uint64(dimension)).astype(np.int64).ravel()]), np.concatenate([c / n[d], np.ones(n_docs * len(LABELLERS))])


def train(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, target: np.ndarray, o: Options) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full batch."""
    w, b = np.zeros(o.dimension), 0.0
    m1, m2 = np.zeros(o.dimension + 1), np.zeros(o.dimension + 1)
    for t in range(1, o.steps + 1 if len(target) else 1):
        z = np.bincount(doc, weights=w[feature] * weight, minlength=len(target)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        grad = np.append(np.bincount(feature, weights=g[doc] * weight, minlength=o.dimension) + o.decay * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        step = o.rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def classify(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, votes, posterior (of the votes alone), score (of the scorer), kept for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=2 << 20):
            c, n = np.unique(pattern(votes(values(*vec.flat(t["text"])))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["pattern", "n"])

    patterns = docs.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    codes = patterns["pattern"].to_numpy(np.int64)
    order = np.argsort(codes)
    codes = codes[order]
    posterior, _ = expectation_maximisation(codes, patterns["n"].to_numpy(np.float64)[order], len(LABELLERS), o.rounds)

    def look(buf: np.ndarray, offs: np.ndarray):
        v = values(buf, offs)
        vo = votes(v)
        at = np.minimum(np.searchsorted(codes, pattern(vo)), max(len(codes) - 1, 0))
        return v, vo, posterior[at]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=2 << 20):
            buf, offs = vec.flat(t["text"])
            v, _, p = look(buf, offs)
            d, f, w = features(buf, offs, v, o.dimension)
            order = np.argsort(d, kind="stable")
            at = pa.array(np.searchsorted(d[order], np.arange(len(t) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.ListArray.from_arrays(at, pa.array(f[order])), pa.ListArray.from_arrays(at, pa.array(w[order]))], names=["p", "f", "w"])

    got = stored(sample_of(docs, o.max_rows).mapInArrow(sample, "p double, f array<long>, w array<double>"), "sample").toArrow()
    f, w = got["f"].combine_chunks(), got["w"].combine_chunks()
    weights, bias = train(np.repeat(np.arange(len(got)), f.value_lengths().to_numpy()), f.flatten().to_numpy(), w.flatten().to_numpy(), got["p"].to_numpy(), o)
    bc = spark.sparkContext.broadcast(weights.tobytes())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(bc.value, np.float64)
        for t in vec.blocks(batches, max_bytes=2 << 20):
            buf, offs = vec.flat(t["text"])
            v, vo, p = look(buf, offs)
            d, f, w = features(buf, offs, v, o.dimension)
            z = np.bincount(d, weights=weights[f] * w, minlength=len(t)) + bias
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * vo.shape[1], pa.int32()), pa.array(vo.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), lists, pa.array(p, pa.float64()), pa.array(s), pa.array(s >= o.cut)], names=["doc_id", "votes", "posterior", "score", "kept"])

    return docs.mapInArrow(score, SCHEMA)
