"""Benchmark decontamination by an FM-index per training shard.

A shard is a block of a partition's texts. All its words are numbered and indexed;
phrases (10-word windows of the benchmark items, or a whole shorter item) are searched
backwards through wavelet-matrix ranks, occurrences are located by sampled suffix
positions, and the word spans they cover are merged for removal. Words are compared by
64-bit hashes.

The benchmark goes out in blocks of at most ``block_bytes`` of text, each a broadcast of
its own. One narrow step indexes a shard once and searches the blocks in it one after
the other, so a task holds one shard and one block, whatever the benchmark's size.

Defined results: null and empty texts, and those without words, have no hits and
stay as they are; null items and those without words match nothing; an item's id
that is null counts as the id "null"; equal ids are one item; repeated rows give
repeated rows; an empty benchmark changes nothing; an empty table stays empty.
Columns of documents other than text pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from . import vec
from .common import small_batches
from .fm_index import FMIndex

WINDOW = 10


class Phrases:
    """The distinct phrases of some items, with the items each belongs to."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        buf, offs = vec.flat(pa.array([t for _, t in items], pa.string()))
        _, _, doc, h = vec.words(buf, offs, vec.ALNUM)
        self.ids = sorted({i for i, _ in items})
        index = {x: k for k, x in enumerate(self.ids)}
        self.vocab, code = np.unique(h, return_inverse=True)
        n, at = vec.counts_of(doc, len(items))
        count = np.where(n > 0, np.maximum(n - window, 0) + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        first = np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        place = first[:, None] + np.arange(window)
        inside = place < (at + n)[item][:, None]
        rows = np.where(inside, code[np.minimum(place, max(len(code) - 1, 0))] + 1 if len(code) else 0, 0).astype(np.int32)
        self.code, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        self.size = (self.code > 0).sum(1)
        owner = np.array([index[items[k][0]] for k in item.tolist()], np.int64)
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.owners = pairs[:, 1].astype(np.int32)
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(self.code) + 1))


class Shard:
    """The words of a block of texts and their index."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array):
        self.buf, self.offs = vec.flat(texts)
        self.start, self.end, self.doc, h = vec.words(self.buf, self.offs, vec.ALNUM)
        self.n_docs = len(self.offs) - 1
        self.n, self.at = vec.counts_of(self.doc, self.n_docs)
        self.hit = np.zeros(len(h), bool)
        self.items: list[set[str]] = [set() for _ in range(self.n_docs)]
        self.vocab, code = np.unique(h, return_inverse=True)
        self.index = FMIndex(code + 1, (self.at + self.n)[self.n > 0], len(self.vocab) + 1) if len(h) else None

    def search(self, p: Phrases) -> None:
        """Marks the words in occurrences of phrases, and tells whose they are."""
        if self.index is None or not len(p.size):
            return
        at = np.minimum(np.searchsorted(self.vocab, p.vocab), len(self.vocab) - 1)
        known = np.where(self.vocab[at] == p.vocab, at + 1, 0)
        codes = np.append(0, known)[p.code]
        some = np.flatnonzero((codes > 0).sum(1) == p.size)  # a word that the shard lacks: no occurrence
        lo, hi = self.index.search(codes[some], p.size[some])
        n = hi - lo
        which = np.repeat(some, n)
        where = self.index.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
        step = np.bincount(where, minlength=len(self.hit) + 1) - np.bincount(where + p.size[which], minlength=len(self.hit) + 1)
        self.hit |= np.cumsum(step)[:-1] > 0
        pair = np.unique(self.doc[where] * np.int64(len(p.size)) + which)
        for d, q in zip((pair // len(p.size)).tolist(), (pair % len(p.size)).tolist(), strict=True):
            self.items[d].update(p.ids[k] for k in p.owners[p.owner_at[q] : p.owner_at[q + 1]])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, first bytes, last bytes) of the merged spans of hit words."""
        s, e = vec.spans(self.hit, self.at)
        return self.doc[s], self.start[s], self.end[e - 1]


def phrase_blocks(benchmark: DataFrame, block_bytes: int = 4 << 20) -> Iterator[Phrases]:
    """Phrases of the items, block by block; the driver holds one block at a time."""
    held, size = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        held.append(("null" if item is None else str(item), text))
        size += len(text or "") * 2 + 16
        if size >= block_bytes:
            yield Phrases(held)
            held, size = [], 0
    yield Phrases(held)


def _sent(benchmark: DataFrame, block_bytes: int) -> list[Broadcast]:
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(p) for p in phrase_blocks(benchmark, block_bytes)]


def _searched(t: pa.Table, blocks: list[Broadcast]) -> Shard:
    shard = Shard(t["text"])
    for b in blocks:
        shard.search(b.value)
        if len(blocks) > 1:  # a worker keeps what it has read, unless told
            vars(b).pop("_value", None)
    return shard


def scan(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """docs (doc_id, text) with n_words, n_hit, spans (code points to remove, merged) and items (ids with a hit)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    blocks = _sent(benchmark, block_bytes)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            x = _searched(t, blocks)
            spans: list[list[dict]] = [[] for _ in range(x.n_docs)]
            own, a, b = x.runs()
            if len(own):
                point = np.concatenate([[0], np.cumsum((x.buf & 0xC0) != 0x80)])
                for d, i, j in zip(own.tolist(), (point[a] - point[x.offs[own]]).tolist(), (point[b] - point[x.offs[own]]).tolist(), strict=True):
                    spans[d].append({"start": i, "end": j})
            n_hit = np.bincount(x.doc[x.hit], minlength=x.n_docs)
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks(), t["text"].combine_chunks(), pa.array(x.n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, span), pa.array([sorted(i) for i in x.items], pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "n_hit", "spans", "items"],
            )

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, text string, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column(b.schema.get_field_index("items")).to_pylist()
            n_hit = b.column(b.schema.get_field_index("n_hit"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(b.schema.get_field_index("n_words")), n_hit, pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array(n_hit.to_numpy() > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return scanned.select("doc_id", "n_words", "n_hit", "items").mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with the hit spans cut out of text; the other columns as they were.

    All blocks mark words of the untouched text before it is cut: the result depends
    neither on the blocks nor on the items' order.
    """
    blocks = _sent(benchmark, block_bytes)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            x = _searched(t, blocks)
            if x.hit.any():
                new = t["text"].to_pylist()
                cuts: dict[int, list[tuple[int, int]]] = {}
                for d, i, j in zip(*(c.tolist() for c in x.runs()), strict=True):
                    cuts.setdefault(d, []).append((i, j))
                for d, spans in cuts.items():
                    keep, last = [], int(x.offs[d])
                    for i, j in spans:
                        keep.append(x.buf[last:i].tobytes())
                        last = j
                    new[d] = b"".join([*keep, x.buf[last : x.offs[d + 1]].tobytes()]).decode()
                t = t.set_column(at, t.schema.field("text"), pa.array(new, t.schema.field("text").type))
            yield from t.combine_chunks().to_batches()

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) n, array_to_string(list_slice(ws, i, i + 9), ' ') w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
