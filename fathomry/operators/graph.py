"""Connected components by moves to smaller ids, with stored rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UsageError


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for all executors; a temporary one only on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise UsageError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/fathomry-checkpoints"
    return f"{where.rstrip('/')}/fathomry/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) over edges (a, b); a component is named by its smallest id. Edges with a null end are none.

    In a round each node with a smaller neighbour goes to the smallest one, and on to where that one goes; the edges are
    then told between the nodes that are left, each once. All joins are shuffled: labels are as many as nodes, but store so
    well that Spark would take them for small, and send them over the driver.
    """
    left = checkpointed(edges.where("a IS NOT NULL AND b IS NOT NULL").select(*_ends("a", "b")))
    moves, alone = [], None
    while True:
        low = checkpointed(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")))
        if alone is None:
            alone = low.where("id = component")  # an edge to themselves and none to a smaller one
        if not low.where("id <> component").limit(1).count():
            break
        if len(moves) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        moves.append(_settled(low.where("id <> component"), rounds))
        of_a, of_b = (moves[-1].select(F.col("id").alias(x), F.col("component").alias(f"to_{x}")).hint("merge") for x in "ab")
        # the larger end of an edge has a smaller neighbour, so it always moves
        moved = left.where("a <> b").join(of_a, "a", "left").join(of_b, "b").select(F.coalesce("to_a", "a").alias("a"), F.col("to_b").alias("b"))
        left = checkpointed(moved.where("a <> b").select(*_ends("a", "b")).distinct())
    if not moves:
        return alone
    labels = moves.pop()
    while moves:
        labels = checkpointed(_on(moves.pop(), labels).unionByName(labels))
    labels = labels.unionByName(labels.select(F.col("component").alias("id"), "component").distinct())
    if alone.limit(1).count():
        labels = labels.unionByName(alone.join(labels.select("id").hint("merge"), "id", "left_anti"))
    return labels


def _ends(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _on(moves: DataFrame, further: DataFrame) -> DataFrame:
    """moves (id, component), continued by further ones from where they end."""
    then = further.select(F.col("id").alias("component"), F.col("component").alias("next")).hint("merge")
    return moves.join(then, "component", "left").select("id", F.coalesce("next", "component").alias("component"))


def _settled(moves: DataFrame, rounds: int) -> DataFrame:
    """moves to smaller ids, followed to their ends: each step doubles how far they reach."""
    for _ in range(rounds):
        ids = moves.select(F.col("id").alias("component")).hint("merge")
        if not moves.join(ids, "component", "left_semi").limit(1).count():
            return moves
        moves = checkpointed(_on(moves, moves))
    raise RuntimeError(f"moves did not settle in {rounds} steps")
