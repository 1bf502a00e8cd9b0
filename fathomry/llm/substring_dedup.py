"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines of at least ``min_words`` words. Bands of MinHash values are
tuned so that a pair just at the threshold is missed with a probability of at most
``miss``; colliding paragraphs are joined, verified by the exact Jaccard similarity
of their five-word shingles, and clustered by connected components (``near``). Of
each cluster the paragraph in the document of the smallest doc_id stays.

A passage can also sit inside a line, or run over lines. So every window of ``min_run``
words is a paragraph too, banded by one MinHash value (its anchor: the smallest hash of
its ``anchor``-word shingles) and verified by equality, for which one band misses
nothing. Every stretch of ``min_run`` words or more that an earlier document has is thus
removed, wherever it begins and ends. Neighbouring windows with the same anchor form a
group, of which only (anchor, hash of the group's words, doc_id) is told: where an anchor
has one group hash, that hash says it all; where it has several, as at the ends of a
stretch, the windows of its groups are compared one by one.

Whether a paragraph, group or window is a repeat depends on its content and the doc_id
alone, so what a document loses is a set of content hashes, joined by doc_id.

Defined results: words are what white space leaves, A-Z in lower case; null texts
stay null, texts without words unchanged; a document that is all repeats keeps an
empty rest; repeats within one document or among rows of one doc_id stay; rows
with a null doc_id come after the others, as documents told by their texts; an empty table stays empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near, vec
from .common import bitmap, fresh, in_bitmap, small_batches, stored



@dataclass(frozen=True)
class Options:
    threshold: float = 0.8
    words: int = 5
    rows: int = 4
    miss: float = 1e-4
    min_words: int = 20
    min_run: int = 40
    anchor: int = 12

    @property
    def plan(self) -> near.Plan:
        return near.Plan(self.words, self.threshold, self.rows, near.tuned(self.threshold, self.rows, self.miss), tolerance=0)


class Units:
    """Words and paragraphs of a block of texts; *_at: first words, *_n: numbers of words."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        self.buf, self.offs = vec.flat(texts)
        self.start, self.end, self.doc, self.h = vec.words(self.buf, self.offs)
        n = len(self.h)
        line = np.concatenate([[0], np.cumsum(self.buf == 10)])[self.start]
        new_line = np.concatenate([[True], (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])])[:n]
        self.p_at, self.p_n, self.p_hash = self._hashed(new_line, 1)

    def _hashed(self, head: np.ndarray, seed: int):
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(head)))
        if not len(at):
            return at, n, np.zeros(0, np.int64)
        pos = np.arange(len(head)) - np.repeat(at, n)
        total = np.add.reduceat(self.h * vec.powers(int(n.max()))[pos], at)
        return at, n, vec.mix(total + n.astype(np.uint64) * np.uint64(2 * seed + 1)).view(np.int64)


class Windows:
    """All windows of min_run words within a text, grouped: neighbours whose smallest anchor-word hash is the same.

    at: first words; g_at: each group's first window, g_n: number of windows, anchor, g_hash: hash of all its words.
    """

    def __init__(self, u: Units, o: Options):
        self.run, n = o.min_run, len(u.h)
        size, _ = vec.counts_of(u.doc, len(u.offs) - 1)
        self.at = np.flatnonzero(np.arange(n) + self.run <= np.cumsum(size)[u.doc])
        back = np.full(n, pow(int(vec.powers(2)[1]), -1, 1 << 64), np.uint64)
        back[:1] = 1
        self._back = np.cumprod(back, dtype=np.uint64)
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(u.h * vec.powers(n)[:n], dtype=np.uint64)])
        self.doc = u.doc[self.at]
        if not len(self.at):
            self.g_at = self.g_n = self.anchor = self.g_hash = np.zeros(0, np.int64)
            return
        k, wide = min(o.anchor, self.run), self.run - min(o.anchor, self.run) + 1
        least, have = self._span(np.arange(n - k + 1), np.full(n - k + 1, k)), 1
        while have < wide:  # the smallest of so many neighbours
            step = min(have, wide - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
        least = least[self.at]
        self.g_at = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (self.doc[1:] != self.doc[:-1])]))
        self.g_n = np.diff(np.append(self.g_at, len(self.at)))
        self.anchor = least[self.g_at]
        self.g_hash = self._span(self.at[self.g_at], self.g_n + self.run - 1)

    def _span(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return vec.mix((self._sum[at + n] - self._sum[at]) * self._back[at] + n.astype(np.uint64)).view(np.int64)

    def hashes(self, some: np.ndarray) -> np.ndarray:
        """Of the windows some."""
        return self._span(self.at[some], np.full(len(some), self.run))

    def of(self, groups: np.ndarray) -> np.ndarray:
        """The windows of groups (a mask)."""
        return np.flatnonzero(np.repeat(groups, self.g_n))


def _order() -> Column:
    """The doc_id; for a null one, an id from 2^62 on that its text tells."""
    return F.coalesce("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))


def _first_rows(o: Options):
    """Rows (kind, a, b, c): 0 band key and paragraph; 1 anchor, doc_id and group; 2 paragraph, doc_id and bytes."""
    plan = o.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            u = Units(t["text"])
            ids = t["doc_id"].to_numpy()
            long = np.flatnonzero(u.p_n >= o.min_words)
            owner = np.full(len(u.h), -1, np.int64)
            for_word = np.repeat(np.arange(len(u.p_at)), u.p_n)
            place = np.full(len(u.p_at), -1, np.int64)
            place[long] = np.arange(len(long))
            owner = place[for_word]
            inside = owner >= 0
            h, par = vec.shingles(u.h[inside], owner[inside], len(long), plan.words)
            bands = near.band_rows(u.p_hash[long], h, par, plan)
            w = Windows(u, o)
            group = _distinct(w.anchor, ids[w.doc[w.g_at]], w.g_hash)
            size = u.end[u.p_at[long] + u.p_n[long] - 1] - u.start[u.p_at[long]]
            paragraph = _distinct(u.p_hash[long], ids[u.doc[u.p_at[long]]], size)
            for kind, a, b, *c in ((0, bands.column(0), bands.column(1)), (1, *group), (2, *paragraph)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(c[0]) if c else pa.nulls(len(a), pa.int64())], names=["kind", "a", "b", "c"])

    return run


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns)
    once = np.ones(len(order), bool)
    once[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return tuple(c[order[once]] for c in columns)


def _windows(bits, o: Options):
    """Rows (u, d): the windows of the groups whose anchors are in the bitmap, and their doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            w = Windows(Units(t["text"]), o)
            some = w.of(in_bitmap(bits.value, w.anchor))
            h, d = _distinct(w.hashes(some), t["doc_id"].to_numpy()[w.doc[some]])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d)], names=["u", "d"])

    return run


def _paragraphs(docs: DataFrame, o: Options):
    def rows_of(bits) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in vec.blocks(batches, max_bytes=1 << 20):
                u = Units(t["text"])
                some = np.flatnonzero(u.p_n >= o.min_words)
                some = some[in_bitmap(bits.value, near.owned_by(u.p_hash[some], t["doc_id"].to_numpy()[u.doc[u.p_at[some]]]))]
                some = some[np.unique(u.p_hash[some], return_index=True)[1]]
                a, b = u.start[u.p_at[some]], u.end[u.p_at[some] + u.p_n[some] - 1]
                raw = u.buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(u.p_hash[some]), pa.array([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string())], names=["item", "text"])

        return docs.select("doc_id", "text").mapInArrow(run, "item long, text string")

    return rows_of


def repeats(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """(d, repeats): for doc_ids with some, the hashes of groups, windows and paragraphs that an earlier document has."""
    small_batches(docs.sparkSession)
    keyed = docs.select(_order().alias("doc_id"), "text")
    rows = stored(keyed.mapInArrow(_first_rows(o), "kind byte, a long, b long, c long"), "units")
    comps = near.candidates(rows.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("item")))
    paragraphs = rows.where("kind = 2")
    items = paragraphs.groupBy(F.col("a").alias("item")).agg(F.min("b").alias("owner"), F.max("c").alias("bytes"))
    _, groups = near.links(_paragraphs(keyed, o), items, comps, o.plan)

    def later(units: DataFrame, key: str) -> DataFrame:
        first = stored(units.groupBy(key).agg(F.min("d").alias("first"), F.max("d").alias("z")).where("first < z").drop("z"), "first")
        return near.matching(units, key, first).join(first, key).where("d > first").select("d", "u")

    anchors = rows.where("kind = 1").select("a", F.col("b").alias("d"), F.col("c").alias("u"))
    shared = anchors.groupBy("a").agg(F.min("d").alias("first"), F.max("d").alias("z"), F.min("u").alias("u0"), F.max("u").alias("u1")).where("first < z")
    shared = stored(shared.select("a", "first", (F.col("u0") == F.col("u1")).alias("whole")), "anchors")
    whole = shared.where("whole").drop("whole")
    same = near.matching(anchors, "a", whole).join(whole, "a").where("d > first").select("d", "u")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(shared.where("not whole"), "a"))
    windows = stored(keyed.mapInArrow(_windows(bits, o), "u long, d long"), "windows")
    paragraphs = paragraphs.select(F.col("a").alias("id"), F.col("b").alias("d")).distinct().join(groups, "id", "left").select(F.col("id").alias("u"), "d", F.coalesce("component", "id").alias("cluster"))
    return same.unionByName(later(windows, "u")).unionByName(later(paragraphs, "cluster")).groupBy("d").agg(F.collect_set("u").alias("repeats"))


def _cut(o: Options, columns: list[str], text_at: int, marked_in: str, report: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            u = Units(t["text"])
            n_docs = len(t)
            marks = t[marked_in].combine_chunks()
            sizes = marks.value_lengths().fill_null(0).to_numpy()
            values = marks.flatten().to_numpy().view(np.uint64)
            salted = lambda h, d: vec.mix(h.view(np.uint64) + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            marked = salted(values, np.repeat(np.arange(n_docs), sizes)) if len(values) else np.zeros(0, np.uint64)
            gone = np.zeros(len(u.h), bool)
            if len(marked) and len(u.h):
                p = np.isin(salted(u.p_hash, u.doc[u.p_at]), marked) & (u.p_n >= o.min_words)
                gone = np.repeat(p, u.p_n)
                w = Windows(u, o)
                mine = sizes[w.doc[w.g_at]] > 0
                known = np.zeros(len(w.g_at), bool)
                known[mine] = np.isin(salted(w.g_hash[mine], w.doc[w.g_at[mine]]), marked)
                rest = w.of(mine & ~known)
                at = w.at[np.concatenate([w.of(known), rest[np.isin(salted(w.hashes(rest), w.doc[rest]), marked)]])]
                step = np.bincount(at, minlength=len(u.h) + 1) - np.bincount(at + o.min_run, minlength=len(u.h) + 1)
                gone |= np.cumsum(step)[:-1] > 0
            texts = t["text"].combine_chunks()
            spans: list[list[dict]] = [[] for _ in range(n_docs)] if report else []
            if gone.any():
                line = np.concatenate([[True], u.doc[1:] != u.doc[:-1]])
                a, b = vec.spans(gone, np.flatnonzero(line))
                own, x, y = u.doc[a], u.start[a], u.end[b - 1]
                new = texts.to_pylist()
                raw = u.buf.tobytes()
                keep: dict[int, list[bytes]] = {}
                at: dict[int, int] = {}
                for d, i, j in zip(own.tolist(), x.tolist(), y.tolist(), strict=True):
                    keep.setdefault(d, []).append(raw[at.get(d, int(u.offs[d])) : i])
                    at[d] = j
                for d, parts in keep.items():
                    new[d] = b"".join([*parts, raw[at[d] : int(u.offs[d + 1])]]).decode()
                texts = pa.array(new, pa.string())
                if report:
                    point = np.concatenate([[0], np.cumsum((u.buf & 0xC0) != 0x80)])
                    for d, i, j in zip(own.tolist(), (point[x] - point[u.offs[own]]).tolist(), (point[y] - point[u.offs[own]]).tolist(), strict=True):
                        spans[d].append({"start": i, "end": j})
            cols = [texts if k == text_at else t[c].combine_chunks() for k, c in enumerate(columns)]
            names = list(columns)
            if report:
                n = np.bincount(u.doc, minlength=n_docs)
                cols += [pa.array(n, pa.int64()), pa.array(np.bincount(u.doc[gone], minlength=n_docs), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                names += ["n_words", "n_removed", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _apply(docs: DataFrame, o: Options, report: bool) -> DataFrame:
    d, marked = fresh("d", docs.columns), fresh("repeats", docs.columns)
    marks = repeats(docs, o).select(F.col("d").alias(d), F.col("repeats").alias(marked))
    joined = docs.join(marks, _order() == F.col(d), "left").drop(d)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    extra = ["n_words long", "n_removed long", "removed array<struct<start:long,end:long>>"] if report else []
    return joined.mapInArrow(_cut(o, docs.columns, docs.columns.index("text"), marked, report), ", ".join(names + extra))


def deduplicate(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """docs with repeated paragraphs and passages cut from text."""
    return _apply(docs, o, False)


def report(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, the text that is left, n_words before, n_removed words, removed spans (code points of the whole text)."""
    return _apply(docs.select("doc_id", "text"), o, True)
