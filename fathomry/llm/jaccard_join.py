"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words are what white space leaves, A-Z in
lower case). MinHash bands propose pairs, the MinHash values are then compared a
few at a time, a pair is dropped once the posterior probability that its
similarity reaches the threshold falls below the tolerance, and what is left is
verified exactly on whole shingle sets. See ``near`` for how groups stay bounded.

Defined results: equal texts are one class (its id: the smallest doc_id) and links
are counted between different texts; a text of fewer than five words, but not none,
is one shingle; null texts and those without words are in no class, group or link:
each row stands alone under its own doc_id; repeated rows are copies; an empty
table gives an empty result; a null doc_id is kept and never names a class unless
all of the class are null; further columns pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near, vec
from .common import fresh, stored

PLAN = near.Plan()
LAST = (1 << 63) - 1


def _bands(plan: near.Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vec.blocks(batches, max_bytes=1 << 20):
            h, doc = near.text_shingles(t["text"], plan.words)
            yield near.band_rows(t["item"].to_numpy().astype(np.int64), h, doc, plan)

    return run


def jaccard_join(docs: DataFrame, plan: near.Plan = PLAN) -> DataFrame:
    """A row per row of docs: doc_id, item (content id, null without words), class_id, n_copies, n_links, group_id."""
    return _joined(docs, plan)[0].drop("group_key")


def _item() -> Column:
    return F.when(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), near.content_id(F.col("text")))


def _joined(docs: DataFrame, plan: near.Plan) -> tuple[DataFrame, DataFrame]:
    """(``jaccard_join``'s rows with their group's key, (group_key, item, class_id) of all classes)."""
    texts = docs.select("doc_id", "text", _item().alias("item")).where("item is not null").select("item", F.coalesce("doc_id", F.lit(LAST)).alias("owner"), "text")
    named = stored(docs.select("doc_id", _item().alias("item"), F.octet_length("text").cast("long").alias("bytes")), "named")
    classes = stored(named.where("item is not null").groupBy("item").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.max("bytes").alias("bytes")), "classes")
    comps = near.candidates(texts.select("item", "text").mapInArrow(_bands(plan), "key long, item long"))
    counted, groups = near.links(near.in_set(texts), classes.select("item", F.coalesce("class_id", F.lit(LAST)).alias("owner"), "bytes"), comps, plan)
    groups = groups.withColumnRenamed("id", "item")
    firsts = stored(groups.join(classes, "item").groupBy("component").agg(F.min("class_id").alias("first")), "firsts")
    classes = classes.drop("bytes").join(counted, "item", "left").join(groups, "item", "left")
    # no hint: the optimizer broadcasts the groups by their size, or else splits the hot ones
    classes = classes.join(firsts, "component", "left").withColumn("group_id", F.when(F.col("component").isNull(), F.col("class_id")).otherwise(F.col("first")))
    classes = stored(classes.withColumn("group_key", F.coalesce("component", "item")).drop("component", "first"), "grouped")
    alone = F.col("item").isNull()  # these rows are spread by their doc_id; what that may meet in the join is not looked at
    rows = named.select("doc_id", "item", F.coalesce("item", F.xxhash64("doc_id")).alias("key")).join(classes.withColumnRenamed("item", "key"), "key", "left")
    rows = rows.select(
        "doc_id",
        "item",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
        F.when(~alone, F.col("group_key")).alias("group_key"),
    )
    return rows, classes.select("group_key", "item", "class_id")


def deduplicate(docs: DataFrame, plan: near.Plan = PLAN) -> DataFrame:
    """docs with one row of each group left, that of the smallest doc_id (null counts as the last); rows without words all stay."""
    rows, classes = _joined(docs, plan)
    # of equal doc_ids in a group with different texts, the smallest content id stays
    kept = stored(classes.groupBy("group_key").agg(F.min(F.struct(F.col("class_id").isNull().alias("last"), "class_id", "item")).alias("k")).select("k.class_id", "k.item"), "keep")
    item, d, i = (fresh(x, docs.columns) for x in ("item", "d", "i"))
    marked = docs.withColumn(item, _item())
    keys = kept.select(F.col("class_id").alias(d), F.col("item").alias(i))
    match = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(item) == F.col(i))
    # repeated rows, of which one stays, are few: their keys are looked up first
    twice = stored(rows.where("item is not null").groupBy("doc_id", "item").count().where("count > 1").select(F.col("doc_id").alias(d), F.col("item").alias(i)), "twice")
    out = marked.join(keys, match, "left_semi")
    if twice.limit(1).count():
        out = out.join(twice, match, "left_anti").unionByName(out.join(twice, match, "left_semi").dropDuplicates(["doc_id", item]))
    return out.drop(item).unionByName(marked.where(F.col(item).isNull()).drop(item))
