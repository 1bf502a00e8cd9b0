"""The prefix trie of a table of conversations: shared beginnings, and what they save.

A turn becomes the SHA-256 of its role and text and a count of words, so no text is shuffled.
Places within a conversation come from one range partitioning by (conversation, turn, digest): rows are
ranked within their range, and a conversation that spans ranges gets their offsets. Prefix digests are chained
in blocks of ``BLOCK`` turns, each block from the empty digest, and over the blocks' last digests:
the digest of a prefix hashes those of the full blocks before with the one within its own. So equal
sequences have equal digests, and no group holds more than a block of turns.

Every prefix is exploded; rows with the same (depth, digest) are a node, named by its depth and its
smallest member. Along one member its nodes lie on a path: the top one hangs below a node of a
smaller member. Sums along a path come first, by blocks; then each path, not each node, is exploded
to all the ancestors above its top, and their rows are added up. That is a row per turn at most.

Defined results: turns are ordered by turn (null first), equal turn numbers by digest; repeated rows
all stay; null role and text are empty; rows without a conv_id belong to no conversation; an
empty table has no nodes, not even a root; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

BLOCK = 256
#: Of a chunk of member ids.
CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _sha(*parts) -> F.Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, digest, words) of all turns, stored."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    t = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role, text)
    size = F.concat(F.octet_length("role").cast("string"), F.lit(":")).cast("binary")
    t = t.select("conv_id", "turn", _sha(size, F.col("role").cast("binary"), F.col("text").cast("binary")).alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    # repeated rows are one row with a count until they have their places
    t = stored(t.groupBy("conv_id", "turn", "digest", "words").agg(F.count("*").alias("n")), "turns")
    dealt = stored(t.repartitionByRange("conv_id", "turn", "digest").withColumn("range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0)))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one conversation goes on from earlier ranges into each
    offsets = dealt.groupBy("conv_id", "range").agg(F.sum("n").alias("n")).withColumn("offset", F.sum("n").over(before)).where("offset > 0").drop("n")
    placed = ranked.join(offsets, ["conv_id", "range"], "left").withColumn("from", F.col("at") + F.coalesce("offset", F.lit(0)))
    return stored(placed.withColumn("pos", F.explode(F.expr("sequence(from, from + n - 1)"))).select("conv_id", "pos", "digest", "words"), "places")


def rebuilt(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): each conversation c with the first h turns of conversation c - c % ``every`` in the place of its own first h,
    h being the crc32 of c in decimals modulo ``most``; and the ids of all conversations, of those without a turn left, too."""
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    bases = convs.where("base = conv_id").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    # at most `every` conversations take from one, each less than `most` turns
    heads = rows.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    heads = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos < taken")
    own = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").withColumn("pos", F.expr("pos - h + taken"))
    columns = ["conv_id", "pos", "digest", "words"]
    return heads.select(columns).unionByName(own.select(columns)), convs.select("conv_id")


def chained(rows: DataFrame) -> DataFrame:
    """Blocks (conv_id, blk, items: digest of the prefix that ends there, words of its last turn), stored; from turns (conv_id, pos, digest, words)."""
    item = F.struct("pos", "digest", "words")
    blocks = rows.withColumn("blk", F.floor(F.col("pos") / BLOCK)).groupBy("conv_id", "blk").agg(F.array_sort(F.collect_list(item)).alias("t"))
    inner = """aggregate(t, named_struct('d', cast('' as binary), 'all', cast(array() as array<struct<digest:binary,words:bigint>>)), (a, x) ->
        named_struct('d', unhex(sha2(concat(a.d, x.digest), 256)), 'all', array_append(a.all, named_struct('digest', unhex(sha2(concat(a.d, x.digest), 256)), 'words', x.words))), a -> a.all)"""
    blocks = stored(blocks.select("conv_id", "blk", F.expr(inner).alias("items")), "blocks")
    last = blocks.select("conv_id", F.struct("blk", F.element_at("items", -1)["digest"].alias("digest")).alias("end"))
    # of conversations of more than a block alone: a digest per full block
    long = blocks.where("blk > 0").select("conv_id").distinct()
    outer = """aggregate(ends, named_struct('d', cast('' as binary), 'all', cast(array() as array<struct<blk:bigint,outer:binary>>)), (a, x) ->
        named_struct('d', unhex(sha2(concat(a.d, x.digest), 256)), 'all', array_append(a.all, named_struct('blk', x.blk + 1, 'outer', unhex(sha2(concat(a.d, x.digest), 256))))), a -> a.all)"""
    before = last.join(long, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list("end")).alias("ends"))
    before = before.select("conv_id", F.inline(F.expr(outer)))
    whole = blocks.join(before, ["conv_id", "blk"], "left")
    items = F.expr("transform(items, x -> named_struct('digest', if(outer is null, x.digest, unhex(sha2(concat(outer, x.digest), 256))), 'words', x.words))")
    return stored(whole.select("conv_id", "blk", items.alias("items")), "prefixes")


def exploded(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Every prefix: conv_id, depth, digest, words; depth 0 for each of the ids."""
    root = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit(EMPTY)).alias("digest"), F.lit(0).cast("long").alias("words"))
    each = blocks.select("conv_id", "blk", F.posexplode("items").alias("i", "x"))
    return root.unionByName(each.select("conv_id", (F.col("blk") * BLOCK + F.col("i") + 1).alias("depth"), "x.digest", "x.words"))


def ends(lengths: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): of the node where conversations end; from (conv_id, depth, digest), a row per conversation.

    Ids are joined in order in chunks first; a node's chunks then pass one hash, which keeps its state alone.
    """
    dealt = lengths.repartitionByRange("depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def row():
            return pa.RecordBatch.from_pylist([{"depth": node[0], "digest": node[1], "first": held[0], "ids": ",".join(map(str, held))}], schema)

        out: list[pa.RecordBatch] = []
        for b in batches:
            for depth, digest, conv in zip(*(b.column(i).to_pylist() for i in (1, 2, 0)), strict=True):
                if held and (node != (depth, digest) or len(held) == CHUNK):
                    out.append(row())
                    held = []
                node = (depth, digest)
                held.append(conv)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if held:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for depth, digest, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if node == (depth, digest):
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), result, strict=True)], schema=result)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*node, state.hexdigest()), result, strict=True)], schema=result)

    schema = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    result = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())])
    joined = dealt.mapInArrow(chunks, "depth long, digest binary, first long, ids string")
    return joined.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def lengths(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, digest): the whole of each conversation."""
    last = F.max(F.struct("blk", F.size("items").alias("n"), F.element_at("items", -1)["digest"].alias("digest"))).alias("e")
    whole = ids.join(blocks.groupBy("conv_id").agg(last), "conv_id", "left")
    return whole.select("conv_id", F.coalesce(F.col("e.blk") * BLOCK + F.col("e.n"), F.lit(0)).cast("long").alias("depth"), F.coalesce("e.digest", F.unhex(F.lit(EMPTY))).alias("digest"))


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, prefix_sha256.

    rows: turns (conv_id, pos, digest, words); ids: all conversations, of which some may have no turn.
    """
    small_batches(rows.sparkSession)
    blocks = chained(rows)
    grouped = exploded(blocks, ids).groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = stored(grouped, "nodes")
    # a path: the nodes of one smallest member, whose last prefix is the lowest; sums along it by blocks of depths
    own = nodes.select("conv_id", "depth", "digest", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), F.floor(F.col("depth") / BLOCK).alias("blk"))
    per_block = own.groupBy("conv_id", "blk").agg(F.sum("saves").alias("in_block"), F.min("depth").alias("top"), F.max("depth").alias("low"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("below", F.coalesce(F.sum("in_block").over(below), F.lit(0)))
    paths = stored(per_block.groupBy("conv_id").agg(F.min("top").alias("top"), F.max("low").alias("low"), F.sum("in_block").alias("total")), "paths")
    upto = Window.partitionBy("conv_id", "blk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("saved", F.sum("saves").over(upto)).join(per_block.select("conv_id", "blk", "below"), ["conv_id", "blk"])
    own = own.select("conv_id", "depth", "digest", "n_convs", (F.col("saved") + F.col("below")).alias("saved"))
    # the node above each path's top; that of a top of depth 1 is the root, whose member is the smallest of all
    root = ids.agg(F.min("conv_id")).first()[0]
    tops = paths.where("top > 1").withColumn("blk", F.expr("(top - 2) div " + str(BLOCK)))
    tops = tops.join(blocks, ["conv_id", "blk"]).select("conv_id", (F.col("top") - 1).alias("depth"), F.expr(f"element_at(items, cast((top - 2) % {BLOCK} + 1 as int)).digest").alias("digest"))
    upper = tops.join(nodes.select("depth", "digest", F.col("conv_id").alias("parent")), ["depth", "digest"]).select("conv_id", "depth", "parent")
    upper = stored(upper.unionByName(paths.where("top = 1").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("parent"))), "parents")
    hanging = stored(upper.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count("*").alias("hanging")), "hanging")
    # a path ends in a leaf unless another hangs there
    at_low = hanging.withColumnRenamed("depth", "low")
    ending = stored(paths.join(at_low, ["conv_id", "low"], "left").select("conv_id", "top", "low", "total", F.when(F.col("hanging").isNull(), 1).otherwise(0).alias("leaf")), "endings")
    # each path exploded to all ancestors of its top
    part = F.expr(f"slice(items, 1, cast(least(top - 1 - blk * {BLOCK}, {BLOCK}) as int))")
    over = ending.where("top > 0").join(blocks, "conv_id").where(F.col("top") - 1 > F.col("blk") * BLOCK)
    over = over.select("blk", "total", "leaf", F.posexplode(part).alias("i", "x")).select((F.col("blk") * BLOCK + F.col("i") + 1).alias("depth"), "x.digest", "total", "leaf")
    at_root = ending.where("top > 0").select(F.lit(0).cast("long").alias("depth"), F.unhex(F.lit(EMPTY)).alias("digest"), "total", "leaf")
    above = over.unionByName(at_root).groupBy("depth", "digest").agg(F.sum("total").alias("saved_above"), F.sum("leaf").alias("leaves"))
    out = own.join(above, ["depth", "digest"], "left").join(ends(lengths(blocks, ids)), ["depth", "digest"], "left")
    out = out.join(hanging, ["conv_id", "depth"], "left").join(ending.select("conv_id", "top", "low", "leaf"), "conv_id")
    out = out.join(upper.select("conv_id", (F.col("depth") + 1).alias("depth"), "parent"), ["conv_id", "depth"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "conv_id", "depth",
        F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        (none("hanging") + (F.col("depth") < F.col("low")).cast("long")).alias("n_children"),
        (F.col("leaf") + none("leaves")).cast("long").alias("n_leaves"),
        (F.col("saved") + none("saved_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
        F.lower(F.hex("digest")).alias("prefix_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    rows = turns(conversations)
    return trie(rows, rows.select("conv_id").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations after ``rebuilt``."""
    return trie(*rebuilt(turns(conversations)))


ORACLE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) t),
o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(role, '') || chr(0) || coalesce(text, ''))) - 1 pos FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (SELECT c conv_id, c - c % 20 base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 4 h
  FROM (SELECT DISTINCT conv_id c FROM o), crc),
r AS (SELECT h.conv_id, pos, role, text FROM h JOIN o ON o.conv_id = base WHERE pos < h UNION ALL SELECT o.conv_id, pos, role, text FROM o JOIN h USING (conv_id) WHERE pos >= h),
p AS (SELECT conv_id, row_number() OVER w depth, sha256(string_agg(sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), '') OVER w) d, len(regexp_extract_all(text, '[^ 	-
]+')) words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
a AS MATERIALIZED (SELECT conv_id, depth, d, words FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM h),
whole AS (SELECT conv_id, max(depth) depth FROM a GROUP BY conv_id),
e AS (SELECT depth, d, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) x FROM a JOIN whole USING (conv_id, depth) GROUP BY ALL),
n AS MATERIALIZED (SELECT depth, d, min(conv_id) c, count(*) n_convs, (count(*) - 1) * max(words) saves FROM a GROUP BY depth, d),
up AS MATERIALIZED (SELECT n.*, q.c parent FROM n LEFT JOIN (a JOIN n q USING (depth, d)) ON a.conv_id = n.c AND a.depth = n.depth - 1),
kids AS (SELECT parent c, depth - 1 depth, count(*) k FROM up WHERE depth > 0 GROUP BY ALL),
below AS (SELECT a.depth, a.d, sum(n.saves) saved, count(*) FILTER (kids.k IS NULL) leaves FROM n LEFT JOIN kids USING (c, depth) JOIN a ON a.conv_id = n.c AND a.depth <= n.depth GROUP BY a.depth, a.d)
SELECT c conv_id, depth, parent parent_conv_id, n_convs, coalesce(k, 0) n_children, leaves n_leaves, CAST(saved AS BIGINT) saved_tokens, coalesce(x, sha256('')) ends_sha256
FROM up LEFT JOIN kids USING (c, depth) JOIN below USING (depth, d) LEFT JOIN e USING (depth, d)
"""
