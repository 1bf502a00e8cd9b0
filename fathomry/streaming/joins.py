"""Joins of two streams by key and time, with bounded state.

Both sides carry watermarks. A pair's times differ by less than a given span, so each side's rows leave the state once the other's
watermark has passed them; an outer join tells an unmatched row then. Time is also cut into buckets of the span: a left row has one,
a right row those it can meet, and the bucket is part of the join's key. So a key with very many rows is spread over tasks and a row meets
its neighbours in time alone, in a batch as in a stream.

Defined results: rows with a null key or time match nothing; in a stream, rows behind the watermark are dropped and counted
(``dropped``); a batch has no late rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _micros(at: Column) -> Column:
    return F.unix_micros(at)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before_s: float, after_s: float, late: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Left rows with the right rows of equal keys from ``before_s`` before them to ``after_s`` after them, both included; how: inner or left_outer.

    Besides the keys and the times, columns of the two sides differ in name. Of the keys the left's are kept.
    """
    before, after = round(before_s * 1e6), round(after_s * 1e6)
    width = max(before + after, 1)
    a = left.withColumn(left_at, F.col(left_at).cast("timestamp")).withWatermark(left_at, late)
    b = right.withColumn(right_at, F.col(right_at).cast("timestamp")).withWatermark(right_at, late)
    a = a.withColumn("__bucket", F.floor((_micros(F.col(left_at)) - before) / width))
    # the windows of left rows begin `before` earlier: a right row lies in one that began in its own bucket or in the one before
    own = F.floor((_micros(F.col(right_at))) / width)
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__in", F.explode(F.array(own - 1, own)))
    same = F.col("__bucket") == F.col("__in")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    span = (F.col(right_at) >= F.col(left_at) - F.expr(f"INTERVAL '{before / 1e6:.6f}' SECOND")) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL '{after / 1e6:.6f}' SECOND"))
    return a.join(b, same & span, how).drop("__bucket", "__in", *(f"__{k}" for k in keys))


def dropped(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, as far as the query's progress tells."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
