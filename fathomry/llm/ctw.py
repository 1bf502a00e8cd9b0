"""Context-tree weighting over bytes: corpus counts, the weighted tree, code lengths.

A text is its bytes, A-Z in lower case, and an end symbol (0xFF, which UTF-8 never
uses); before it the context is 0xFF too. A byte is eight binary decisions, each a
node of a binary tree over bytes. For every context of the last d bytes, d = 0 to
``DEPTH``, and node, the training texts give counts of zeros and ones and so a
Krichevsky-Trofimov estimate KT. The weighted probability of a context is

    Pw(s) = 1/2 KT(s) + 1/2 product of Pw(one byte longer contexts),

KT alone at the greatest depth. A bit is predicted by mixing the estimates of all
depths with the posterior weights KT(s) / 2 Pw(s); where a longer context was
never seen, its parent's own estimate stands in, so predictions stay normalised.

Steps: (1) each block of a partition counts its (context, byte) keys of six bytes and
its words, Spark adds them up; (2) keys are grouped by their last two context bytes,
by three or four where more than ``most`` keys share those, which keeps every subtree below
that depth in one group, and the levels above are finished from sums; (3) every key has one log
probability, and scoring a text is adding those of its keys. The most frequent keys and
words, ``HOT`` at most, are broadcast; counts of the others go to a join and come back as sums.

Defined results: a null or empty text is the end symbol (one token); a null doc_id is
a training document; repeated rows count and are scored each; an empty table gives
no rows; without training texts every byte has probability 1/256 and no word is known; other columns are left out. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import small_batches, stored

DEPTH = 5
#: Bound on broadcast keys, and on broadcast words: 16 bytes each.
HOT = 1 << 20
END = np.uint64(0x51A7E0DD5EED0001)
KEYS, WORDS = 0, 1
LN10 = np.log(10)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series after seven steps up."""
    z = x + 7
    shift = np.ones_like(x)
    for k in range(7):
        shift = shift * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - np.log(np.pi) - lgamma(n0 + n1 + 1.0)


def keys_of(buf: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts, a key for each byte and end: depth context bytes and the byte, oldest first; and their documents."""
    n_docs, size = len(offs) - 1, np.diff(offs)
    at = offs[:-1] + np.arange(n_docs) * (depth + 1)  # where a text's padding begins
    out = np.full(len(buf) + n_docs * (depth + 1), 255, np.uint8)
    out[np.arange(len(buf)) + np.repeat((np.arange(n_docs) + 1) * (depth + 1) - 1, size)] = vec.LOWER[buf]
    key = np.zeros(len(out) - depth if len(out) else 0, np.uint64)
    for k in range(depth + 1):
        key |= out[k : len(key) + k].astype(np.uint64) << np.uint64(8 * (depth - k))
    inside = np.ones(len(key), bool)
    for k in range(1, depth + 1):  # windows that begin in one text's last bytes and end in the next one's padding
        bad = at[1:] - k
        inside[bad[bad >= 0]] = False
    return key[inside], np.repeat(np.arange(n_docs), size + 1)


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and documents, with an end token for each document."""
    _, _, doc, h = vec.words(buf, offs)
    n_docs = len(offs) - 1
    return np.concatenate([h, np.full(n_docs, END)]), np.concatenate([doc, np.arange(n_docs)])


def _crc(ids: pa.ChunkedArray) -> np.ndarray:
    import zlib

    return np.array([-1 if x is None else zlib.crc32(str(x).encode()) % 7 for x in ids.to_pylist()], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in vec.blocks(batches, max_bytes=2 << 20):
        buf, offs = vec.flat(t["text"])
        train = _crc(t["doc_id"]) != 2
        key, doc = keys_of(buf, offs)
        both = np.sort((key << np.uint64(1)) | train[doc].astype(np.uint64))
        head = np.flatnonzero(np.concatenate([[True], both[1:] >> np.uint64(1) != both[:-1] >> np.uint64(1)])) if len(both) else np.zeros(0, np.int64)
        k = both[head] >> np.uint64(1)
        n = np.diff(np.append(head, len(both)))
        n_train = np.add.reduceat((both & np.uint64(1)).astype(np.int64), head) if len(head) else n
        h, d = words_of(buf, offs)
        code, uniq = pd.factorize(h)
        c = np.bincount(code, weights=train[d], minlength=len(uniq)).astype(np.int64)
        all_ = np.bincount(code, minlength=len(uniq)).astype(np.int64)
        for kind, a, b, e in ((KEYS, k, n_train, n), (WORDS, uniq, c, all_)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b), pa.array(e)], names=["kind", "key", "n_train", "n_all"])


def _nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes that lead to a byte, and the bit at each (a row per byte)."""
    k = np.arange(8)
    b = byte.astype(np.int64)[:, None]
    return (1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1


def subtree(key: np.ndarray, n: np.ndarray, low: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The weighted tree of depths low to depth over keys with training counts n.

    Returns (ids, n0, n1, log Pw) at depth low, ids being context * 256 + node, and
    for each key its eight bit predictions there (NaN where nothing was seen).
    """
    ctx, byte = (key >> np.uint64(8)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)
    nodes, bits = _nodes(byte)
    seen = np.flatnonzero(n > 0)
    levels = []
    for d in range(low, depth + 1):
        c = ctx & ((1 << (8 * d)) - 1)
        ids = ((c[seen, None] << 8) | nodes[seen]).ravel()
        code, uniq = pd.factorize(ids)
        w = np.repeat(n[seen], 8).astype(np.float64)
        ones = bits[seen].ravel()
        n1 = np.bincount(code, weights=w * ones, minlength=len(uniq))
        n0 = np.bincount(code, weights=w, minlength=len(uniq)) - n1
        levels.append((pd.Index(uniq), n0, n1, log_kt(n0, n1)))
    log_pw, weights = levels[-1][3], [np.ones(len(levels[-1][0]))]
    for j in range(len(levels) - 2, -1, -1):
        d = low + j
        child = levels[j + 1][0].to_numpy()
        parent = levels[j][0].get_indexer((((child >> 8) & ((1 << (8 * d)) - 1)) << 8) | (child & 255))
        below = np.bincount(parent, weights=log_pw, minlength=len(levels[j][0]))
        log_pw = np.logaddexp(levels[j][3], below) - np.log(2)
        weights.insert(0, np.exp(levels[j][3] - np.log(2) - log_pw))
    p = np.full(nodes.shape, np.nan)
    for j in range(len(levels) - 1, -1, -1):
        index, n0, n1, _ = levels[j]
        at = index.get_indexer((((ctx & ((1 << (8 * (low + j))) - 1))[:, None] << 8) | nodes).ravel()).reshape(nodes.shape)
        p = mixed(np.where(at >= 0, at, 0), at >= 0, bits, n0, n1, weights[j], p) if len(index) else p
    return levels[0][0].to_numpy(), levels[0][1], levels[0][2], log_pw, p


def mixed(at, known, bits, n0, n1, weight, below):
    """One level's estimate mixed with the prediction from below."""
    kt = (np.where(bits == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
    w = np.where(np.isnan(below), 1.0, weight[at])
    return np.where(known, w * kt + (1 - w) * np.nan_to_num(below), below)


def _group(t: pa.Table) -> pa.Table:
    key, n, low = t["key"].to_numpy().view(np.uint64), t["n_train"].to_numpy(), t["low"][0].as_py()
    ids, n0, n1, log_pw, p = subtree(key, n, low)
    none, top = np.zeros(len(key)), len(ids)
    above = ids & ((1 << (8 * low)) - 1)  # the same node of the context one byte shorter
    return pa.table({
        "level": pa.array(np.concatenate([np.full(len(key), -1), np.full(top, low - 1)]).astype(np.int8)),
        "key": pa.array(np.concatenate([key.view(np.int64), above])),
        "p": pa.array([*(x.tobytes() for x in p.astype(np.float32)), *[None] * top], pa.binary()),
        "n0": pa.array(np.concatenate([none, n0])), "n1": pa.array(np.concatenate([none, n1])), "log_pw": pa.array(np.concatenate([none, log_pw])),
    })


def _split(rows: DataFrame, most: int) -> Column:
    """How many context bytes name the group of a key: 2; 3 where more than `most` keys share the two, 4 where they share three.

    Four leave 65,536 keys at most. The driver sees the contexts with more than `most` keys, so their number divided by `most`.
    """

    def large(of: DataFrame, d: int) -> list[int]:
        return [c for c, _ in of.groupBy(_context(d).alias("c")).count().where(F.col("count") > most).collect()]

    two = large(rows, 2)
    three = large(rows.where(_context(2).isin(two)), 3) if two else []
    return F.when(_context(3).isin(three), 4).when(_context(2).isin(two), 3).otherwise(2)


def _context(d: int) -> Column:
    return F.shiftright("key", 8).bitwiseAND((1 << (8 * d)) - 1)


def model(counts: DataFrame, keys_a_task: int = 150_000, most: int = 300_000) -> DataFrame:
    """(key, logp): the natural log probability of each key's byte after its context."""
    rows = counts.where(f"kind = {KEYS}").select("key", "n_train")
    tasks = max(1, rows.count() // keys_a_task)
    rows = rows.withColumn("low", _split(rows, most))
    context = F.when(F.col("low") == 4, _context(4)).when(F.col("low") == 3, _context(3)).otherwise(_context(2))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("low", context), F.lit(tasks)))
    tree = stored(rows.groupBy("low", "task").applyInArrow(_group, "level byte, key long, p binary, n0 double, n1 double, log_pw double"), "tree")
    # nodes of contexts of one byte, 65,280 at most, and of the split contexts of two and three
    top = tree.where("p is null").groupBy("level", "key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "log_pw"))).toPandas()
    tables, below = {}, pd.DataFrame({"key": np.zeros(0, np.int64), "n0": [], "n1": [], "log_pw": []}).astype({"n0": float, "n1": float, "log_pw": float})
    for d in (3, 2, 1, 0):
        own = top.loc[top["level"] == d, ["key", "n0", "n1", "log_pw"]]
        now = pd.concat([own, below] if len(below) else [own]).groupby("key", sort=True).sum().reset_index()
        ids, n0, n1 = now["key"].to_numpy(np.int64), now["n0"].to_numpy(np.float64), now["n1"].to_numpy(np.float64)
        kt = log_kt(n0, n1)
        pw = np.logaddexp(kt, now["log_pw"].to_numpy(np.float64)) - np.log(2)
        tables[d] = ids, n0, n1, np.exp(kt - np.log(2) - pw)
        below = pd.DataFrame({"key": ids & ((1 << (8 * d)) - 1), "n0": n0, "n1": n1, "log_pw": pw})
    place = {}
    for d in (1, 0):
        place[d] = np.full(1 << (8 * (d + 1)), -1)
        place[d][tables[d][0]] = np.arange(len(tables[d][0]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            p = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, 8).astype(np.float64)
            nodes, bits = _nodes(key & np.uint64(255))
            for d, (ids, m0, m1, w) in tables.items():
                if len(ids):
                    at = (((key >> np.uint64(8)).astype(np.int64) & ((1 << (8 * d)) - 1))[:, None] << 8) | nodes
                    if d in place:
                        i = place[d][at]
                    else:
                        i = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                        i = np.where(ids[i] == at, i, -1)
                    p = mixed(np.where(i >= 0, i, 0), i >= 0, bits, m0, m1, w, p)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.log(np.where(np.isnan(p), 0.5, p)).sum(1))], names=["key", "logp"])

    return stored(tree.where("p is not null").select("key", "p").mapInArrow(finish, "key long, logp double"), "model")


def _threshold(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` keys occur that often."""
    bins = {int(r["b"]): r["n"] for r in counts.groupBy(F.floor(F.log2(F.greatest("n_all", F.lit(1)).cast("double") + 0.5)).alias("b")).agg(F.count("*").alias("n")).collect()}  # 64 at most
    total, level = 0, 64
    while level > 0 and total + bins.get(level - 1, 0) <= most:
        level -= 1
        total += bins.get(level, 0)
    return 1 << min(level, 62)


def _hot(table: DataFrame, value: str) -> tuple[bytes, bytes]:
    got = table.select("key", value).toArrow()
    k, v = got["key"].to_numpy().view(np.uint64), got[value].to_numpy()
    order = np.argsort(k)
    return k[order].tobytes(), v[order].tobytes()


def _look(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, values[at]


ROW = "kind byte, rid long, key long, n long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, logp double"


def score(docs: DataFrame, hot: int = HOT, most: int = 300_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs (doc_id, text).

    bits_per_byte: the code length over the number of bytes, the end symbol being one of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    counts = stored(docs.mapInArrow(_count, "kind byte, key long, n_train long, n_all long").groupBy("kind", "key").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all")), "counts")
    logp = model(counts, most=most)
    tokens, distinct = counts.where(f"kind = {WORDS}").agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.count_if(F.col("n_train") > 0), F.lit(0))).first()
    floor = -np.log10(tokens + distinct + 1)
    keys = counts.where(f"kind = {KEYS}").select("key", "n_all").join(logp, "key")
    words = counts.where(f"kind = {WORDS}").select("key", "n_all", "n_train")
    key_level, word_level = _threshold(keys, hot), _threshold(words, hot)
    bc = spark.sparkContext.broadcast((*_hot(keys.where(F.col("n_all") >= key_level), "logp"), *_hot(words.where(F.col("n_all") >= word_level), "n_train")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hk, hv, wk, wv = (np.frombuffer(x, kind) for x, kind in zip(bc.value, (np.uint64, np.float64, np.uint64, np.int64), strict=True))
        rid = TaskContext.get().partitionId() << 40
        for t in vec.blocks(batches, max_bytes=1 << 20):
            buf, offs = vec.flat(t["text"])
            n_docs = len(t)
            mine = rid + np.arange(n_docs)
            rid += n_docs
            # key and document in one integer, so a plain sort groups them
            key, doc = keys_of(buf, offs)
            both = np.sort((key << np.uint64(16)) | doc.astype(np.uint64))
            head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            n = np.diff(np.append(head, len(both)))
            k, d = both[head] >> np.uint64(16), (both[head] & np.uint64(0xFFFF)).astype(np.int64)
            known, v = _look(k, hk, hv)
            logs = np.bincount(d[known], weights=(v * n)[known], minlength=n_docs).astype(np.float64)
            h, wd = words_of(buf, offs)
            n_tokens = np.bincount(wd, minlength=n_docs).astype(np.int64)
            w_known, c = _look(h, wk, wv)
            base = np.bincount(wd[w_known], weights=np.log10(c[w_known] + 1.0) + floor, minlength=n_docs).astype(np.float64)
            n_known = np.bincount(wd[w_known & (c > 0)], minlength=n_docs).astype(np.int64)
            crc = _crc(t["doc_id"])
            null = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n_docs, -1, np.int8)), pa.array(mine), null(n_docs, pa.int64()), null(n_docs, pa.int64()), t["doc_id"].combine_chunks().cast(pa.int64()), pa.array(crc == 2), pa.array(n_tokens), pa.array(n_known), pa.array(np.diff(offs) + 1), pa.array(base, pa.float64()), pa.array(logs, pa.float64())],
                names=[x.split()[0] for x in ROW.split(", ")],
            )
            rest = ~w_known
            code, uniq = pd.factorize(vec.mix(h[rest] + wd[rest].astype(np.uint64)))
            first = np.zeros(len(uniq), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            for kind, a, b, m in ((KEYS, k[~known], d[~known], n[~known]), (WORDS, h[rest][first], wd[rest][first], np.bincount(code, minlength=len(uniq)))):
                s = len(a)
                if s:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(s, kind, np.int8)), pa.array(mine[b]), pa.array(a.view(np.int64)), pa.array(m.astype(np.int64)), null(s, pa.int64()), null(s, pa.bool_()), null(s, pa.int64()), null(s, pa.int64()), null(s, pa.int64()), null(s, pa.float64()), null(s, pa.float64())],
                        names=[x.split()[0] for x in ROW.split(", ")],
                    )

    rows = stored(docs.mapInArrow(run, ROW), "partial")
    rare_keys = rows.where(f"kind = {KEYS}").select("rid", "key", "n").join(keys.where(F.col("n_all") < key_level).select("key", F.col("logp").alias("l")), "key").select("rid", (F.col("l") * F.col("n")).alias("logp"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("n_known"))
    rare_words = rows.where(f"kind = {WORDS}").select("rid", "key", "n").join(words.where(F.col("n_all") < word_level).select("key", F.col("n_train").alias("c")), "key")
    rare_words = rare_words.select("rid", F.lit(0.0).alias("logp"), ((F.log10(F.col("c") + 1.0) + float(floor)) * F.col("n")).alias("base"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"))
    each = rows.where("kind = -1").select("rid", "logp", "base", "n_known", "doc_id", "held_out", "n_tokens", "n_bytes")
    parts = each.unionByName(rare_keys.unionByName(rare_words), allowMissingColumns=True)
    out = parts.groupBy("rid").agg(*(F.sum(c).alias(c) for c in ("logp", "base", "n_known")), *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_bytes")))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("logp") / float(LN10)).alias("score"), (F.col("logp") / (F.col("n_bytes") * float(-np.log(2)))).alias("bits_per_byte"))
