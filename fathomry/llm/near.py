"""Similarity links between texts: MinHash bands, candidate components, block comparison.

Items are named by a 64-bit id of their content, so copies are one item from the
start. The steps keep every group bounded:

1. ``band_rows``: a row (band key, item) per band, each block of a partition
   telling each pair once; no text moves.
2. Keys shared by different items give star edges to the key's smallest item, and
   their connected components hold every colliding pair.
3. Of each item in a component one row is chosen (the item's owner) and its text put
   into a block: small components go together into blocks of about ``BLOCK`` items and
   ``BLOCK_BYTES`` of text, larger ones are cut into as many blocks as that takes.
4. Each block is compared within. A row per linked item comes back: its number of
   links and the smallest item it is linked with, directly or not (its root).
5. Blocks of one component are compared pair by pair. Back come a number per linked
   item and edges between the blocks' roots, a spanning forest: blocks whose items are
   all linked give one edge, whatever their size. No pair of items is ever told.

In a task, all pairs of a component are looked at: those that the Bayesian test
(``bayes_table``) gives up are dropped, the rest are compared exactly on their whole
shingle sets. A component of n items costs n * n / 2 looks, shared among tasks of
``BLOCK`` * ``BLOCK``; what is stored grows with n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import bitmap, components, in_bitmap, small_batches, stored

BLOCK = 2048
BLOCK_BYTES = 2 << 20
#: Pairs looked at in one go.
PAIRS = 1 << 15


@dataclass(frozen=True)
class Plan:
    """Words in a shingle, the least similarity, rows and bands, the tolerance of the pruning (0: none)."""

    words: int = 5
    threshold: float = 0.8
    rows: int = 5
    bands: int = 26
    tolerance: float = 1e-6
    step: int = 13  # MinHash values compared before each look at the posterior

    @property
    def hashes(self) -> int:
        return self.rows * self.bands


def tuned(threshold: float, rows: int, miss: float) -> int:
    """Bands so that a pair just at the threshold fails to collide with probability of at most miss."""
    return int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))


@lru_cache
def bayes_table(plan: Plan) -> np.ndarray:
    """Least matches among the first n MinHash values, n = step, 2 step, ..., for a pair to stay.

    With a uniform prior, m matches of n give the similarity a Beta(m + 1, n - m + 1)
    posterior; a pair goes when P(similarity >= threshold) < tolerance.
    """
    x = np.linspace(0, 1, 20_001)[1:-1]
    out = []
    for n in range(plan.step, plan.hashes + 1, plan.step):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(x) + (n - m) * np.log1p(-x)
        p = np.exp(log - log.max(1, keepdims=True))
        tail = p[:, x >= plan.threshold].sum(1) / p.sum(1)
        out.append(int(np.argmax(tail >= plan.tolerance)))
    return np.array(out)


def minhash(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a shingle, their k MinHash values); h is grouped by document."""
    rng = np.random.default_rng(20240229)
    mult = rng.integers(1, 1 << 32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    salt = rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)
    n, at = vec.counts_of(doc, n_docs)
    has = np.flatnonzero(n)
    out = np.empty((len(has), k), np.uint32)
    if not len(has):
        return has, out
    x, start = (h >> np.uint64(32)).astype(np.uint32), at[has]
    tmp = np.empty_like(x)
    for j in range(k):
        np.bitwise_xor(x, salt[j], out=tmp)
        np.multiply(tmp, mult[j], out=tmp)
        out[:, j] = np.minimum.reduceat(tmp, start)
    return has, out


def band_keys(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """A 64-bit key for each document and band."""
    keys = np.empty((len(sig), plan.bands), np.uint64)
    for b in range(plan.bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(plan.rows):
            h = vec.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * plan.rows + r].astype(np.uint64))
        keys[:, b] = h
    return keys


def band_rows(ids: np.ndarray, h: np.ndarray, doc: np.ndarray, plan: Plan) -> pa.RecordBatch:
    """Rows (key, item) of a block; ids: each document's item."""
    _, first = np.unique(ids, return_index=True)
    mine = np.zeros(len(ids), bool)
    mine[first] = True
    keep = mine[doc]
    has, sig = minhash(h[keep], doc[keep], len(ids), plan.hashes)
    keys = band_keys(sig, plan)
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[has], plan.bands))], names=["key", "item"])


def candidates(rows: DataFrame) -> DataFrame:
    """(id, component) of all items that share a key of rows (key, item) with another."""
    small_batches(rows.sparkSession)
    rows = stored(rows, "bands")
    shared = stored(rows.groupBy("key").agg(F.min("item").alias("a"), F.max("item").alias("z")).where("a < z").drop("z"), "shared")
    return components(matching(rows, "key", shared).join(shared, "key").where("item <> a").select("a", F.col("item").alias("b")))


def matching(rows: DataFrame, column: str, others: DataFrame) -> DataFrame:
    """rows whose column may be in that of others: a fixed-size filter that keeps the rest out of the join's shuffle."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(others, column))
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(bits.value, b.column(at).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, rows.schema)


class Sets:
    """The shingle sets and MinHash values of a block's items."""

    def __init__(self, texts: pa.ChunkedArray, plan: Plan):
        h, doc = text_shingles(texts, plan.words)
        self.n, self.plan = len(texts), plan
        h, self.at = vec.distinct_pairs(h, doc, self.n)
        self.size = np.diff(self.at)
        has, sig = minhash(h, np.repeat(np.arange(self.n), self.size), self.n, plan.hashes)
        self.sig = np.zeros((self.n, plan.hashes), np.uint32)
        self.sig[has] = sig
        uniq, self.code = np.unique(h, return_inverse=True)
        self.mark = np.zeros(len(uniq), bool)

    def alive(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose sizes allow the threshold and that the Bayesian test doesn't give up."""
        p = self.plan
        ok = np.minimum(self.size[i], self.size[j]) >= np.maximum(p.threshold * np.maximum(self.size[i], self.size[j]) - 1e-9, 1)
        i, j = i[ok], j[ok]
        if p.tolerance > 0:
            same = np.zeros(len(i), np.int64)
            for s, least in enumerate(bayes_table(p)):
                cols = slice(s * p.step, (s + 1) * p.step)
                same += (self.sig[i, cols] == self.sig[j, cols]).sum(1)
                ok = same >= least
                i, j, same = i[ok], j[ok], same[ok]
        return i, j

    def linked(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of js whose exact similarity to i reaches the threshold."""
        own = self.code[self.at[i] : self.at[i + 1]]
        self.mark[own] = True
        m = self.size[js]
        where = np.repeat(self.at[js] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        both = np.add.reduceat(self.mark[self.code[where]].astype(np.int64), np.cumsum(m) - m)
        self.mark[own] = False
        return js[both >= self.plan.threshold * (self.size[i] + m - both) - 1e-9]


def compare(sets: Sets, first: np.ndarray, last: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links per item, label) where item i is compared with first[i] .. last[i] - 1; linked items get the least of their labels."""
    links, label = np.zeros(sets.n, np.int64), label.copy()
    m = np.maximum(last - first, 0)
    total = np.concatenate([[0], np.cumsum(m)])
    for lo in range(0, int(total[-1]), PAIRS):
        pair = np.arange(lo, min(lo + PAIRS, int(total[-1])))
        i = np.searchsorted(total, pair, "right") - 1
        i, j = sets.alive(i, first[i] + pair - total[i])
        cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            one = int(i[a])
            js = sets.linked(one, j[a:b])
            links[one] += len(js)
            links[js] += 1
            if len(js) and (label[js] != label[one]).any():
                merged = np.unique(np.append(label[js], label[one]))
                label[np.isin(label, merged)] = merged[0]
    return links, label


def text_shingles(texts: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = vec.flat(texts)
    _, _, doc, h = vec.words(buf, offs)
    return vec.shingles(h, doc, len(offs) - 1, words)


FOUND = "a long, b long, n long"


def _found(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _once(t: pa.Table) -> pa.Table:
    """A row per item, by component and item."""
    ids = t["item"].to_numpy()
    order = np.lexsort((ids, t["component"].to_numpy()))
    order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])[: len(order)]]
    return t.take(pa.array(order))


def _within(plan: Plan):
    """Rows (item, root, links) of the linked items of a block."""

    def run(t: pa.Table) -> pa.Table:
        t = _once(t)
        ids, comp = t["item"].to_numpy(), t["component"].to_numpy()
        n, label = compare(Sets(t["text"], plan), np.arange(len(ids)) + 1, np.searchsorted(comp, comp, "right"), np.arange(len(ids)))
        some = np.flatnonzero(n)
        return _found(ids[some], ids[label[some]], n[some])

    return run


def _across(plan: Plan):
    """Of two blocks of a component: rows (item, item, links) and (root, root, 0)."""

    def run(t: pa.Table) -> pa.Table:
        t = _once(t)
        side, lo = t["side"].to_numpy(), t["lo"].to_numpy()
        t = t.take(pa.array(np.argsort(side != lo, kind="stable")))
        ids, n_lo = t["item"].to_numpy(), int((side == lo).sum())
        roots, start = np.unique(t["root"].to_numpy(), return_inverse=True)
        first, last = np.full(len(ids), n_lo), np.where(np.arange(len(ids)) < n_lo, len(ids), 0)
        n, label = compare(Sets(t["text"], plan), first, last, start)
        some = np.flatnonzero(n)
        joined = np.unique(np.stack([start, label], 1)[start != label], axis=0)
        return _found(np.concatenate([ids[some], roots[joined[:, 0]]]), np.concatenate([ids[some], roots[joined[:, 1]]]), np.concatenate([n[some], np.zeros(len(joined), np.int64)]))

    return run


def links(rows_of: Callable[[Broadcast], DataFrame], items: DataFrame, comps: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """((item, n_links), (item, group)) over items that have a link.

    items: (item, owner, bytes), each item once, owner being the id of the row whose text is taken;
    rows_of: from a broadcast bitmap, rows (item, text) of at least those whose ``owned`` key is in it;
    comps: (id, component) from ``candidates``.
    """
    spark = comps.sparkSession
    sized = stored(comps.withColumnRenamed("id", "item").join(items, "item"), "sized")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    # no hint: the optimizer broadcasts it by its size, or else splits the hot components
    large = stored(sized.groupBy("component").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    tasks = sized.agg(F.greatest(F.count("*") / BLOCK, F.coalesce(F.sum("bytes"), F.lit(0)) / BLOCK_BYTES)).first()[0]
    placed = sized.join(large, "component", "left").select(
        "item",
        "component",
        F.coalesce("blocks", F.lit(1)).alias("blocks"),
        F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("component"), F.lit(int(tasks) + 1))).otherwise(F.col("component")).alias("task"),
        F.when(F.col("blocks").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("item"), "blocks")).cast("int").alias("side"),
    )
    bits = spark.sparkContext.broadcast(bitmap(sized.select(owned("item", "owner").alias("o")), "o"))
    rows = stored(rows_of(bits).join(placed, "item"), "blocks")
    found = stored(rows.groupBy("task", "side").applyInArrow(_within(plan), FOUND), "links")
    edges, counts = found.where("a <> b").select("a", "b"), found.select(F.col("a").alias("item"), "n")
    if large.limit(1).count():
        rooted = rows.where("side >= 0").join(found.select(F.col("a").alias("item"), F.col("b").alias("root")), "item", "left").withColumn("root", F.coalesce("root", "item"))
        pairs = rooted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> side")
        pairs = pairs.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
        across = stored(pairs.groupBy("task", "lo", "hi").applyInArrow(_across(plan), FOUND).groupBy("a", "b").agg(F.sum("n").alias("n")), "links")
        edges = edges.unionByName(across.where("a <> b").select("a", "b"))
        counts = counts.unionByName(across.where("a = b").select(F.col("a").alias("item"), "n"))
    return counts.groupBy("item").agg(F.sum("n").alias("n_links")), components(edges)


def owned(item: str, owner: str) -> Column:
    """The key of an item's row of that owner; ``owned_by`` is the same in numpy."""
    return F.expr(f"{item} ^ shiftleft({owner}, 20) ^ shiftrightunsigned({owner}, 44)")


def owned_by(item: np.ndarray, owner: np.ndarray) -> np.ndarray:
    o = owner.astype(np.int64).view(np.uint64)
    return (item.astype(np.int64).view(np.uint64) ^ (o << np.uint64(20)) ^ (o >> np.uint64(44))).view(np.int64)


def in_set(texts: DataFrame) -> Callable[[Broadcast], DataFrame]:
    """For ``links``: the rows (item, text) of texts (item, owner, text)."""

    def rows_of(bits: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in vec.blocks(batches, max_bytes=1 << 20):
                ids = t["item"].to_numpy()
                new = np.zeros(len(ids), bool)
                new[np.unique(ids, return_index=True)[1]] = True
                yield from t.select(["item", "text"]).filter(pa.array(new & in_bitmap(bits.value, owned_by(ids, t["owner"].to_numpy())))).to_batches()

        return texts.select("item", "owner", "text").mapInArrow(run, "item long, text string")

    return rows_of


def content_id(text: Column) -> Column:
    """The id of a text: equal texts, equal ids."""
    return F.xxhash64(text)
