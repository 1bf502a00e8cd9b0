"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts count as labelled; every other text is unlabelled, toxic
ones among them. With class prior p the classifiers minimise

    p * R+(P) + max(0, R-(U) - p * R-(P))

where R+ and R- are mean logistic losses over positives (P) and unlabelled texts (U).
Where the second term is under zero its gradient is followed backwards, so the
estimate of the negatives' risk can't be driven below nothing.

Features are presences of words and of word beginnings of 4 to 8 bytes (letters and
digits, A-Z in lower case), hashed. The ``features`` that tell P from U most
significantly are kept. ``bags`` classifiers, each with its share of U, are averaged.

Fitting takes at most ``max_positive`` and ``max_unlabelled`` texts, those with the
smallest hashes of (doc_id, text): a bounded, reproducible sample. Scoring is narrow and
covers every whole text. The model is ``features`` * ``bags`` numbers.

Defined results: null and empty texts get the score of a text without features;
a text's copies get equal scores; a null doc_id is never learnt from and not held
out; labels that are null, or of documents that aren't there, are ignored; of several labels for
a doc_id, a toxic one counts; without any toxic label every score is 0; repeated
rows give repeated rows; an empty table stays empty; other columns pass through ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import sample as sample_of
from .common import small_batches, stored

PREFIXES = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Options:
    threshold: float = 0.3
    max_positive: int = 4000
    max_unlabelled: int = 9000
    features: int = 4096
    bags: int = 3
    steps: int = 150
    rate: float = 0.05
    decay: float = 1e-2


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray  # a row per bag
    bias: np.ndarray

    def score(self, feature: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """feature: places in hashes, a distinct set for each document."""
        if not len(self.bias):
            return np.zeros(n_docs)
        z = np.stack([np.bincount(doc, weights=w[feature], minlength=n_docs) for w in self.weights]) + self.bias[:, None]
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).mean(0)


def features(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(feature hashes, documents, number of documents), repeats included."""
    buf, offs = vec.flat(texts)
    buf = vec.LOWER[buf]
    start, end, doc, h = vec.words(buf, offs, vec.ALNUM, lower=False)
    out, docs = [h], [doc]
    for k in PREFIXES:
        long = end - start > k
        out.append(vec.mix(vec.hash_spans(buf, start[long], start[long] + k) + np.uint64(k)))
        docs.append(doc[long])
    return np.concatenate(out), np.concatenate(docs), len(offs) - 1


def held_out(doc_id: Column, of: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def _losses(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of log(1 + e^-z) and log(1 + e^z)."""
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return p - 1, p


def nnpu(rows: np.ndarray, cols: np.ndarray, n_rows: int, n_cols: int, positive: np.ndarray, unlabelled: np.ndarray, prior: float, o: Options) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier; (rows, cols): the ones of a binary matrix, positive and unlabelled: rows."""
    w, b = np.zeros(n_cols), np.log(prior / (1 - prior))
    m1, m2 = np.zeros(n_cols + 1), np.zeros(n_cols + 1)
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    for t in range(1, o.steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n_rows) + b
        zp, zu = z[positive], z[unlabelled]
        plus, _ = _losses(zp)
        _, minus_p = _losses(zp)
        _, minus_u = _losses(zu)
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = np.zeros(n_rows)
        sign = 1.0 if negative_risk >= 0 else -1.0
        if sign > 0:
            g[positive] += prior * plus / n_p
        np.add.at(g, unlabelled, sign * minus_u / n_u)
        np.add.at(g, positive, -sign * prior * minus_p / n_p)
        grad = np.append(np.bincount(cols, weights=g[rows], minlength=n_cols) + o.decay * prior * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        step = o.rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def chosen(hashes: np.ndarray, df_p: np.ndarray, df_u: np.ndarray, n_p: int, n_u: int, o: Options) -> np.ndarray:
    """The features, sorted, whose shares of positives and of unlabelled texts differ most for their error."""
    if not n_p or not n_u:
        return np.zeros(0, np.uint64)
    pool = (df_p + df_u + 1) / (n_p + n_u + 2)
    z = np.abs(df_p / n_p - df_u / n_u) / np.sqrt(pool * (1 - pool) * (1 / n_p + 1 / n_u))
    z[df_p + df_u < 5] = 0
    best = np.lexsort((hashes, -z))[: o.features]
    return np.sort(hashes[best[z[best] > 3]])


def fit_places(rows: np.ndarray, cols: np.ndarray, hashes: np.ndarray, positive: np.ndarray, prior: float, o: Options) -> Model:
    """From the chosen features (places in hashes) of the sample's texts."""
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(hashes):
        return Model(hashes, np.zeros((0, 0)), np.zeros(0))
    fits = [nnpu(rows, cols, len(positive), len(hashes), pos, unl[k :: o.bags], prior, o) for k in range(o.bags) if len(unl[k :: o.bags])]
    return Model(hashes, np.stack([w for w, _ in fits]), np.array([b for _, b in fits]))


def fit(docs: DataFrame, labels: DataFrame, o: Options = Options(), learn: Column | None = None) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic); learn: which rows' labels may be seen (default: not held out)."""
    small_batches(docs.sparkSession)
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    seen = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Model(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0))
    prior = min(max(toxic / n, 1e-3), 0.5)
    order = F.xxhash64("doc_id")
    positives = seen.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(o.max_positive)
    texts = docs.select("doc_id", "text")
    # at most max_positive ids: a bounded broadcast
    p = sample_of(texts.join(F.broadcast(positives), "doc_id"), o.max_positive).withColumn("positive", F.lit(True))
    u = sample_of(texts.where(learn), o.max_unlabelled).withColumn("positive", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            h, doc, n_docs = features(t["text"])
            order = np.argsort(doc, kind="stable")
            values, offs = vec.distinct_pairs(h[order], doc[order], n_docs)
            yield pa.RecordBatch.from_arrays([t["positive"].combine_chunks(), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values.view(np.int64)))], names=["positive", "features"])

    sample = stored(p.unionByName(u).mapInArrow(run, "positive boolean, features array<long>"), "sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            uniq, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            is_p = np.repeat(b.column(0).to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy())
            df_p = np.bincount(code[is_p], minlength=len(uniq))
            yield pa.RecordBatch.from_arrays([pa.array(uniq), pa.array(df_p), pa.array(np.bincount(code, minlength=len(uniq)) - df_p)], names=["h", "p", "u"])

    sizes = dict(sample.groupBy("positive").agg(F.count("*")).collect())
    df = sample.mapInArrow(frequencies, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    # the best features alone come to the driver, ranked as in `chosen`; hashes are unsigned
    pool = (F.col("p") + F.col("u") + 1) / F.lit(n_p + n_u + 2)
    z = F.abs(F.col("p") / F.lit(max(n_p, 1)) - F.col("u") / F.lit(max(n_u, 1))) / F.sqrt(pool * (1 - pool) * F.lit(1 / max(n_p, 1) + 1 / max(n_u, 1)))
    df = df.where("p + u >= 5").orderBy(z.desc(), F.col("h") < 0, "h").limit(o.features).toPandas()
    hashes = chosen(df["h"].to_numpy(np.int64).view(np.uint64), df["p"].to_numpy(np.int64), df["u"].to_numpy(np.int64), n_p, n_u, o)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            h = lists.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
            hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
            offs = np.searchsorted(row[hit], np.arange(len(b) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(at[hit].astype(np.int32)))], names=["positive", "places"])

    got = sample.mapInArrow(places, "positive boolean, places array<int>").toArrow()
    lists = got["places"].combine_chunks()
    rows = np.repeat(np.arange(len(got)), lists.value_lengths().to_numpy())
    return fit_places(rows, lists.flatten().to_numpy().astype(np.int64), hashes, got["positive"].to_numpy(), prior, o)


def scores(texts: pa.ChunkedArray, model: Model) -> np.ndarray:
    h, doc, n_docs = features(texts)
    if not len(model.hashes) or not len(h):
        none = np.zeros(0, np.int64)
        return model.score(none, none, n_docs)
    at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
    hit = model.hashes[at] == h
    pair = np.unique(doc[hit] * np.int64(len(model.hashes)) + at[hit])
    return model.score(pair % len(model.hashes), pair // len(model.hashes), n_docs)


def classify(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(scores(t["text"], model), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= o.threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """docs without those that the classifier calls toxic."""
    model = fit(docs, labels, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            yield from t.filter(pa.array(scores(t["text"], model) < o.threshold)).combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)
