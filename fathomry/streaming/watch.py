"""Live watching: events of acquisitions (``tracker``), quality rules (``rules``), event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import DEFAULT_RULES, Rule, judge, load_rules
from .tracker import EVENT, LOOK, Options, counted, replay, watch

__all__ = ["DEFAULT_RULES", "EVENT", "EVENTS", "LOOK", "Options", "Rule", "counted", "judge", "load_rules", "replay", "watch"]

#: Kinds of events.
EVENTS = ["dataset_new", "plane_new", "scan_new", "frame_new", "dataset_complete", "dataset_stalled", "qc", "error"]


def event_log(events: DataFrame, after: int, limit: int) -> DataFrame:
    """A page of a numbered event table."""
    return events.where(F.col("seq") > after).orderBy("seq").limit(limit)


def baseline_ratio(df: DataFrame, keys: list[str], order: list[str], value: str, first: int) -> DataFrame:
    """value over the median of the first so many of its group, with n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("n", F.row_number().over(w) - 1)
    base = d.where(F.col("n") < first).groupBy(*keys).agg(F.median(value).alias("__base"))
    return d.join(base, keys).withColumn("ratio", F.try_divide(F.col(value), F.col("__base"))).drop("__base")


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts and means per event-time window; late rows are taken up to the watermark."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "mean")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return e.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def stalls(df: DataFrame, keys: list[str], at: str, limit_s: float) -> DataFrame:
    """Gaps over the limit in a recorded stream: the batch form of the stall timer."""
    w = Window.partitionBy(*keys).orderBy(at)
    d = df.withColumn("gap_s", (F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double")))
    return d.where(F.col("gap_s") >= limit_s)


def distinct_units(events: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each unit once while the watermark remembers it."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
