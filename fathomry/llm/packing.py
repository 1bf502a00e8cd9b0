"""Best-two-fit packing of token sequences.

A document is its token ids and an end id; one longer than a sequence is cut into
whole sequences' worth of tokens, the first piece being the rest. A sequence is
filled greedily with the longest piece that fits; then its smallest piece gives way
to the two unpacked pieces that fill the wider gap best, if they fill it better.

Only how many pieces there are of each length matters for that, so the driver packs
the histogram (at most ``size`` numbers, whatever the input): each round makes one
pattern of lengths and uses it as often as the histogram allows. Pieces then find
their place by length and rank. Ranks come from counts per (length, partition) and a
running sum over partitions, so a length that a third of the rows share is no hot task.

Defined results: null and empty texts are the end id alone (length 1); repeated rows
are packed each; an empty table gives an empty result; a null doc_id is kept;
further columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenize, vec
from .common import small_batches, stored

SIZE, END = 2048, 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, local long"


def best_two_fit(count: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: how many}, times) that use up count[length], length 1 to size."""
    left = count.astype(np.int64).copy()
    lengths = np.arange(size + 1)
    out = []
    while left.any():
        use = np.zeros(size + 1, np.int64)
        gap = size

        def largest(limit: int) -> int:
            some = np.flatnonzero(left[: limit + 1] > use[: limit + 1])
            return int(some[-1]) if len(some) else 0

        while gap and (x := largest(gap)):
            take = min(gap // x, int(left[x] - use[x]))
            use[x] += take
            gap -= take * x
        if gap:
            small = int(np.flatnonzero(use)[0])
            use[small] -= 1
            free = left > use
            wide = gap + small
            # for every first piece a, the longest second one b that fits
            floor = np.maximum.accumulate(np.where(free, lengths, 0))
            a = np.flatnonzero(free[: wide + 1])
            b = floor[wide - a]
            twice = (b == a) & (left[a] - use[a] < 2)
            if twice.any():
                below = np.maximum(np.minimum(b, a) - 1, 0)
                b = np.where(twice, floor[below], b)
            total = np.where(b > 0, a + b, 0)
            best = int(np.argmax(total)) if len(a) else 0
            if len(a) and total[best] > small:
                use[a[best]] += 1
                use[b[best]] += 1
            else:
                use[small] += 1
        some = np.flatnonzero(use)
        times = int((left[some] // use[some]).min())
        left -= times * use
        out.append(({int(x): int(use[x]) for x in some[::-1]}, times))
    return out


def runs(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, a sequence's share, first sequence, offset) for every length of every pattern."""
    out, rank, seq = [], {}, 0
    for use, times in patterns:
        offset = 0
        for x, n in use.items():
            r = rank.get(x, 0)
            out.append((x, r, r + n * times, n, seq, offset))
            rank[x] = r + n * times
            offset += n * x
        seq += times
    return out


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece of docs (doc_id, text), numbered within partition and length; with_ids: also the ids."""
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        encoder = tokenize.encoder(path)
        for t in vec.blocks(batches, max_bytes=1 << 20):
            ids, offs = encoder.encode(t["text"])
            n_docs = len(t)
            full = np.empty(len(ids) + n_docs, np.uint32)
            doc_at = offs + np.arange(n_docs + 1)
            full[np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(offs))] = ids
            full[doc_at[1:] - 1] = end
            total = np.diff(doc_at)
            n = -(-total // size)
            doc = np.repeat(np.arange(n_docs), n)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = total - (n - 1) * size  # the first piece takes the rest
            start = np.where(k > 0, first[doc] + (k - 1) * size, 0)
            length = np.where(k > 0, size, first[doc])
            raw = memoryview(full.astype("<u4").view(np.uint8))
            at = doc_at[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            s = length[order]
            within = np.arange(len(s)) - np.searchsorted(s, s)
            local = np.empty(len(s), np.int64)
            local[order] = seen[s] + within
            seen += np.bincount(length, minlength=size + 1)
            cols = [t["doc_id"].combine_chunks().take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), pid, np.int32)), pa.array(local)]
            names = [x.split()[0] for x in PIECE.split(", ")]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(full)), pa.int32()), pa.array(full.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset, gapless from 0 in each sequence."""
    spark = docs.sparkSession
    small_batches(spark)
    cut = stored(pieces(docs, path, size, end, with_ids), "pieces")
    counts = cut.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in base.groupBy("length").agg(F.sum("n")).collect():  # at most size rows
        histogram[length] = n
    table = spark.createDataFrame(runs(best_two_fit(histogram, size)), "length long, r0 long, r1 long, share long, seq long, off long")
    ranked = cut.join(base.drop("n"), ["length", "pid"]).withColumn("rank", F.col("base") + F.col("local"))
    # a row per length of each pattern; every pattern uses up a length, so size bounds it
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & F.col("rank").between(F.col("r0"), F.col("r1") - 1)).drop(table["length"])
    turn = F.col("rank") - F.col("r0")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.expr("(rank - r0) div share")).alias("sequence_id"),
        (F.col("off") + (turn % F.col("share")) * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the pieces (doc_id, piece, offset) in them."""
    placed = pack(docs, path, size, end, with_ids=True)
    each = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return each.selectExpr("sequence_id", "flatten(transform(p, x -> x.ids)) ids", "transform(p, x -> struct(x.doc_id, x.piece, x.offset)) pieces")
