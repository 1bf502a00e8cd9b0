"""Consistent-hash ring with virtual nodes and bounded loads.

A shard owns ``virtual`` points on the ring; a key belongs to the first point at or
after its hash. Shards have room for a fixed number of rows; the rooms differ by one at
most and add up to all rows, so counts end at most one apart (law ``rows``). Keys
that meet a full shard go on clockwise to the next point of a shard with room. When
shards are added, keys move into the new shards' arcs and out of what overflowed.

Only the number of keys on each arc decides who overflows: shards * virtual numbers
go to the driver, whatever the input. A key finds its place by its rank on the arc,
from counts per (arc, partition) and a running sum over partitions; equal keys in
any number are no hot task, as ranks don't need a key's rows together.

Defined results: a null text has 0 bytes (size 8) and the checksum of an empty one; a null doc_id
is hashed as text "null"; repeated rows are rows of their own; fewer rows than
shards leave some shards empty; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

VIRTUAL = 64
#: Arcs are found by a hash of this many bits.
BITS = 32


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of all points, clockwise."""
    points = {}
    for s in range(shards):
        for v in range(virtual):
            at = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big") >> (32 - BITS)
            points[at] = min(s, points.get(at, s))
    return sorted(points.items())


def rooms(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for counts of keys by arc.

    First every arc fills its own shard, clockwise; then what overflows goes on from
    its arc to the next points whose shards have room.
    """
    left, slot, out, over = list(room), [0] * len(room), [], []

    def put(arc: int, r0: int, n: int, s: int) -> None:
        if n:
            out.append((arc, r0, r0 + n, s, slot[s]))
            slot[s] += n
            left[s] -= n

    for arc, (_, s) in enumerate(points):
        n = counts.get(arc, 0)
        put(arc, 0, took := min(n, left[s]), s)
        if n > took:
            over.append((arc, took, n))
    for arc, r, end in over:
        k = arc
        while r < end:
            k += 1
            s = points[k % len(points)][1]
            put(arc, r, took := min(end - r, left[s]), s)
            r += took
    return out


def _arc(h: Column, points: list[tuple[int, int]]) -> Column:
    """The place of the first point at or after a hash: a bucket table, then at most a few points."""
    positions = [p for p, _ in points]
    width, table = BITS - 12, []
    for b in range(1 << 12):
        table.append(bisect_left(positions, b << width))
    first = F.element_at(F.array(*map(F.lit, table)), (F.shiftright(h, width) + 1).cast("int"))
    deepest = max(sum(b << width <= p < (b + 1) << width for p in positions) for b in range(1 << 12))
    pos = F.array(*map(F.lit, positions))
    passed = sum(((F.coalesce(F.get(pos, first + k), F.lit(1 << BITS)) < h).cast("int") for k in range(deepest)), F.lit(0))
    return F.pmod(first + passed, F.lit(len(points)))


def shard(docs: DataFrame, shards: int = 24, virtual: int = VIRTUAL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    points = ring(shards, virtual)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    h = F.shiftright(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 64 - BITS).bitwiseAND((1 << BITS) - 1)
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), h.alias("h"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.withColumn("arc", _arc(F.col("h"), points)).drop("h"), "keys").withColumn("part", F.shiftright("row", 33))
    counts = rows.groupBy("arc", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    by_arc = {r["arc"]: r["n"] for r in base.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # at most shards * virtual rows
    runs = place(by_arc, points, rooms(sum(by_arc.values()), shards))
    # a row per arc and one more each time a shard fills: bounded by shards * (virtual + 1) + arcs
    table = spark.createDataFrame(runs, "arc int, r0 long, r1 long, shard int, slot0 long")
    local = F.row_number().over(Window.partitionBy("arc", "part").orderBy("row")) - 1
    ranked = rows.withColumn("local", local).join(base.drop("n"), ["arc", "part"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.join(F.broadcast(table), (ranked["arc"] == table["arc"]) & F.col("rank").between(F.col("r0"), F.col("r1") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("r0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
