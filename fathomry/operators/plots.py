"""What figures are drawn from: binned, spread and thinned points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def density(df: DataFrame, keys: list[str], x: str, y: str, bins: int = 64) -> DataFrame:
    """Counts on a grid over the data's own range."""
    r = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if r[0] is None:
        return df.select(*keys, F.lit(0).alias("bx"), F.lit(0).alias("by"), F.lit(0).cast("long").alias("count")).limit(0)
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) * bins / ((hi - lo) or 1.0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, cell(x, r[0], r[1]).alias("bx"), cell(y, r[2], r[3]).alias("by")).agg(F.count("*").alias("count"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean with sd, sem and range of each group."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return out.withColumn("sem", F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double"))))


def apex(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The highest point of each trace, the first on a tie."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(x, y), F.struct(F.col(y), -F.col(x))).alias("p")).select(*keys, "p.*")


def preview_bins(n: int, resolution: int) -> int:
    """160 bins, three quarters of them while they are finer than the data, 24 at least."""
    bins = 160
    while bins * 3 // 4 >= 24 and bins > max(resolution, 1):
        bins = bins * 3 // 4
    return max(24, min(bins, max(n, 24)))


def current_frequency(spikes: DataFrame, keys: list[str], current: str, duration_s: float) -> DataFrame:
    """Spikes a second of each step, and the rheobase: the least current with a spike."""
    f = spikes.groupBy(*keys, current).agg((F.count("t") / duration_s).alias("frequency"))
    return f.withColumn("rheobase", F.min(F.when(F.col("frequency") > 0, F.col(current))).over(Window.partitionBy(*keys)))
