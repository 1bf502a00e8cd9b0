"""Phrase collocation mining: the word sequences of a language that belong together.

Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and those at blanks
into words. Rows of 1..max_n-grams are counted per language, level by level. Within a task a
block of texts becomes counted rows (lang, phrase, f) before anything is shuffled; Spark adds
them up by phrase. An n-gram can only reach ``min_count`` where both (n-1)-grams in it do, so from
the second level on a block leaves out n-grams with a part that a bit set of the frequent
(n-1)-grams' hashes does not have. The bit set (``common.bitmap``, at most 32 MB) has false positives only:
counts are exact, told apart by the phrase itself, and where far more phrases are frequent than
it has bits more rows are shuffled.

Each candidate is cut after each of its words, the parts' counts are joined, and the score is a
quotient of decimals. Candidates inside a longer one that takes most of their occurrences are
anti-joined; as f only falls with length, extensions by one word speak for all longer ones.

Defined results: a null text is empty; a null lang is ``und``; an empty table gives no rows;
repeated rows count again; other columns are left out. Ties go by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vec
from .common import bitmap, in_bitmap, small_batches, stored

CUT = np.zeros(256, dtype=bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~CUT
WORD[[0x20, 0x09]] = False
#: A key is the phrase, a line end, and the language: no phrase holds one. One column is less to shuffle than two.
SCHEMA = "key string, f long"
STEP = vec.U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    max_n: int = 4
    min_count: int = 30
    top: int = 2000  # of each language
    scale: int = 2_000_000
    absorbed: int = 80  # percent of the occurrences that a longer candidate takes
    block_bytes: int = 2 << 20


def grams(t: pa.Table, n: int, frequent: list[bytes]) -> pa.Table:
    """The counted n-grams of a block (lang, text) whose shorter parts may all be frequent: ``SCHEMA``."""
    buf, offs = vec.flat(t["text"])
    buf = vec.LOWER[buf]
    start, end = vec.spans(WORD[buf], offs)
    doc = np.searchsorted(offs, start, "right") - 1
    piece = np.cumsum(CUT[buf])[start] + doc if len(start) else start
    langs = t["lang"].fill_null("und").combine_chunks().dictionary_encode()
    places = np.append(0, np.cumsum(end - start)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(places.tobytes()), pa.py_buffer(buf[WORD[buf]].tobytes())).dictionary_encode()
    word, size = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)

    h_word = _hashes(words.dictionary)
    # own: per place the number of the n-gram that begins there; lang, parts and h belong to these numbers
    seen, own, count = np.unique(langs.indices.to_numpy().astype(np.int64)[doc] * size + word, return_inverse=True, return_counts=True)
    lang, parts = seen // size, [seen % size]
    h = vec.mix(_hashes(langs.dictionary)[lang] + h_word[parts[0]]) if len(seen) else h_word[:0]
    live = np.ones(len(word), dtype=bool)
    for k in range(2, n + 1):
        live &= in_bitmap(frequent[k - 2], h.view(np.int64))[own]
        at = np.flatnonzero(live[:-1] & live[1:] & (piece[:-1] == piece[1:]) if k == 2 else live[:-1] & live[1:])
        seen, inverse, count = np.unique(own[at] * size + word[at + k - 1], return_inverse=True, return_counts=True)
        shorter, last = seen // size, seen % size
        lang, parts = lang[shorter], [p[shorter] for p in parts] + [last]
        h = vec.mix(h[shorter] * STEP + h_word[last])
        live = np.zeros(len(word), dtype=bool)
        live[at] = True
        own = np.zeros(len(word), np.int64)
        own[at] = inverse
        if not len(seen):
            break
    if len(parts) < n or not len(lang):
        return pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], names=["key", "f"])
    texts = [words.dictionary.take(pa.array(p)) for p in parts]
    phrase = pc.binary_join_element_wise(*texts, " ") if n > 1 else texts[0]
    return pa.table([pc.binary_join_element_wise(phrase, langs.dictionary.take(pa.array(lang)), "\n"), pa.array(count.astype(np.int64))], names=["key", "f"])


def _hashes(values: pa.Array) -> np.ndarray:
    b, o = vec.flat(values)
    return vec.hash_spans(b, o[:-1], o[1:])


def phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """The hash that ``grams`` looks for in a bit set: of the language, then word by word."""
    buf, offs = vec.flat(phrase)
    start, end = vec.spans(buf != 0x20, offs)
    n, at = vec.counts_of(np.searchsorted(offs, start, "right") - 1, len(offs) - 1)
    h_word = vec.hash_spans(buf, start, end)
    h = vec.mix(_hashes(lang) + h_word[at]) if len(h_word) else h_word
    for k in range(1, int(n.max(initial=0))):
        more = n > k
        h[more] = vec.mix(h[more] * STEP + h_word[at[more] + k])
    return h.view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(b.column(0), b.column(1)))], names=["h"])


def counted(docs: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): all words (lang, phrase, f), and the phrases of 1..max_n words with f >= min_count (also words: their number), stored."""
    small_batches(docs.sparkSession)
    texts = docs.select("lang", "text")
    sets: list = []

    def level(n: int) -> DataFrame:
        held = list(sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in vec.blocks(batches, max_bytes=o.block_bytes):
                yield from grams(t, n, [b.value for b in held]).to_batches(max_chunksize=20_000)

        sums = texts.mapInArrow(run, SCHEMA).groupBy("key").agg(F.sum("f").alias("f"))
        return sums.select(F.expr("substring(key, instr(key, '\\n') + 1)").alias("lang"), F.substring_index("key", "\n", 1).alias("phrase"), "f")

    words = stored(level(1), "words")
    levels = [words.where(F.col("f") >= o.min_count)]
    for n in range(2, o.max_n + 1):
        sets.append(docs.sparkSession.sparkContext.broadcast(bitmap(levels[-1].select("lang", "phrase").mapInArrow(_hashed, "h long"), "h")))
        levels.append(stored(level(n).where(F.col("f") >= o.min_count), f"phrases-{n}"))
    each = [x.select("lang", "phrase", "f", F.lit(n).alias("words")) for n, x in enumerate(levels, 1)]
    return words, reduce(DataFrame.unionByName, each)


def scored(phrases: DataFrame, o: Options = Options()) -> DataFrame:
    """Every candidate (two words or more): lang, phrase, words, a, and of its lowest cut score, k, l, r."""
    cuts = phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("w", F.split("phrase", " "))
    cuts = cuts.selectExpr("lang", "phrase", "words", "f a", "k", "array_join(slice(w, 1, k), ' ') first", "array_join(slice(w, k + 1, words - k), ' ') rest")
    left, right = (phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(c)) for part, c in (("first", "l"), ("rest", "r")))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    score = F.expr(f"(cast({o.scale} as decimal(10, 0)) * {wide('a')}) div ({wide('l')} + {wide('r')})")
    lowest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "words", "a", "cut.*")


def standing(candidates: DataFrame, o: Options = Options()) -> DataFrame:
    """The candidates that no longer one absorbs."""
    longer = candidates.where("words > 2").withColumn("w", F.split("phrase", " "))
    inner = longer.select("lang", F.explode(F.array(F.expr("array_join(slice(w, 1, words - 1), ' ')"), F.expr("array_join(slice(w, 2, words - 1), ' ')"))).alias("phrase"), F.col("a").alias("taken"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("taken").alias("taken")).toDF("in_lang", "inner", "taken")
    covers = F.expr(f"cast(taken as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {o.absorbed}")
    return candidates.join(inner, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inner")) & covers, "left_anti")


def collocations(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score, words, k."""
    words, phrases = counted(docs, o)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = standing(stored(scored(phrases, o), "candidates"), o).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= o.top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"), "words", "k")


_D = Options()
ORACLE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) s FROM documents),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') w FROM p),
g AS (SELECT lang, words, array_to_string(w[i : i + words - 1], ' ') phrase FROM (SELECT lang, w, words, unnest(range(1, len(w) - words + 2)) i FROM w, range(1, {_D.max_n + 1}) r(words))),
f AS MATERIALIZED (SELECT lang, phrase, words, count(*) f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) n FROM f WHERE words = 1 GROUP BY lang),
t AS MATERIALIZED (SELECT * FROM f WHERE f >= {_D.min_count}),
c AS MATERIALIZED (SELECT lang, phrase, words, f a, string_split(phrase, ' ') w FROM t WHERE words > 1),
cut AS (SELECT c.*, k, l.f l, r.f r, CAST((CAST({_D.scale} AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) score
  FROM (SELECT *, unnest(range(1, words)) k FROM c) c JOIN t l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') JOIN t r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = b.lang AND x.words > b.words AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.a >= {_D.absorbed} * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank, phrase, a, l, r, n, score, words, k
FROM kept JOIN n USING (lang) QUALIFY rank <= {_D.top}
"""
