"""What the operators share around Spark: stored stages, clash-free columns, components.

Stages that later steps read more than once are written as Parquet under the
session's ``spark.checkpoint.dir`` (shared by all executors), which also cuts
lineage: a lost executor costs a re-read, not a recomputation. The files stay
until the owner of that folder clears it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is set and there is one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/fathomry-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def small_batches(spark: SparkSession, size: str = "2m", row_group: int = 16 << 20) -> None:
    """Bounds in bytes what Spark hands to a Python worker at once, and what a task holds of a Parquet file it writes.

    By default 10,000 rows go, however long, and 128 MB of texts are kept until a row group is written.
    The operators regroup batches (``vec.blocks``), so the bounds change memory alone. They hold for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("parquet.block.size", str(row_group))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fathomry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table; of its columns only those named, if any."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def fresh(name: str, columns: list[str]) -> str:
    """A column name like `name` that isn't among columns, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the connected components of edges (a, b), named by their smallest id.

    In a round each node that has a smaller neighbour goes to the smallest one, and on to where
    that one goes. The edges are then told between the nodes that are left, each once, and those
    within one node go. A node that is left after two rounds is the smallest within two steps, so
    at least half of them go; the first round alone joins all edges, and each node goes once.
    Aggregates are partial before the shuffle and joins can be split by AQE, so a node with very
    many edges is no hot task. Each round's edges and moves are stored.
    """
    pairs = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    left = stored(edges.where("a <> b").select(*pairs("a", "b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while left.limit(1).count():
        if len(moves) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        moves.append(_settled(stored(left.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id"), "moves"), rounds))
        of_a, of_b = (moves[-1].select(F.col("id").alias(x), F.col("component").alias(f"to_{x}")) for x in "ab")
        # the larger end of an edge has a smaller neighbour, so it always moves
        moved = left.join(of_a, "a", "left").join(of_b, "b").select(F.coalesce("to_a", "a").alias("a"), F.col("to_b").alias("b"))
        left = stored(moved.where("a <> b").select(*pairs("a", "b")).distinct(), "edges")
    if not moves:
        return left.toDF("id", "component")
    labels = moves.pop()
    while moves:
        labels = stored(_on(moves.pop(), labels).unionByName(labels), "labels")
    return labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct())


def _on(moves: DataFrame, further: DataFrame) -> DataFrame:
    """moves (id, component), continued by further ones from where they end."""
    then = further.select(F.col("id").alias("component"), F.col("component").alias("next"))
    return moves.join(then, "component", "left").select("id", F.coalesce("next", "component").alias("component"))


def _settled(moves: DataFrame, rounds: int) -> DataFrame:
    """moves to smaller ids, followed to their ends: each step doubles how far they reach."""
    for _ in range(rounds):
        ids = moves.select(F.col("id").alias("component"))
        if not moves.join(ids, "component", "left_semi").limit(1).count():
            return moves
        moves = stored(_on(moves, moves), "moves")
    raise RuntimeError(f"moves did not settle in {rounds} steps")


#: Bounds on the 64-bit words of a bitmap: 32 KB to 32 MB.
WORDS = 1 << 12, 1 << 22


def bitmap(ids: DataFrame, column: str) -> bytes:
    """A bit set over a hash column, built by a partial bitwise or: 32 to 64 bits a row between the bounds ``WORDS``.

    Membership has false positives, never false negatives: an exact join follows wherever it is
    used, which has the whole work to do again where far more rows than bits fill the set.
    """
    import numpy as np

    words = WORDS[0]
    most = ids.count() // 2
    while words < min(most, WORDS[1]):
        words *= 2
    bits = ids.select(F.col(column).alias("h")).selectExpr(f"pmod(shiftright(h, 6), {words}) w", "shiftleft(1L, cast(h & 63 as int)) b")
    got = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(words, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.tobytes()


def in_bitmap(bits, h):
    """Which of the 64-bit hashes h (numpy) may be in the set."""
    import numpy as np

    table = np.frombuffer(bits, np.int64)
    h = h.astype(np.int64)
    return (table[(h >> 6) % len(table)] >> (h & 63)) & 1 == 1


def sample(docs: DataFrame, most: int) -> DataFrame:
    """At most `most` different rows (doc_id, text): those with the smallest hashes.

    The hashes alone are sorted, the texts are then filtered by the last hash that is in.
    """
    h = F.xxhash64("doc_id", "text")
    last = docs.select(h.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    name = fresh("h", docs.columns)
    return docs.withColumn(name, h).where(F.col(name) <= (last if last is not None else 0)).dropDuplicates([name]).drop(name)
