"""Ordered computations: ranks, gaps, sliding fits, smoothing, crossings, envelopes, areas.

Built from window functions over (keys, order); arrays per key only where a frame can't be constant.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import nearest_ranks


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def run_order(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("run_order", F.row_number().over(_w(keys, order)))


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ranks from 1, ties sharing the mean of theirs."""
    w = Window.partitionBy(*keys, value)
    return df.withColumn("rank", F.rank().over(_w(keys, [value])) + (F.count("*").over(w) - 1) / 2)


def intervals(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """isi (gap to the row before) and isi_ratio (its quotient with the gap before)."""
    w = _w(keys, order)
    d = df.withColumn("isi", F.col(x) - F.lag(x).over(w))
    return d.withColumn("isi_ratio", F.try_divide(F.col("isi"), F.lag("isi").over(w)))


def adaptation_index(df: DataFrame, keys: list[str], order: list[str], isi: str = "isi") -> DataFrame:
    """In the gaps' order, the mean over neighbours of (next - this) / (next + this)."""
    w = _w(keys, order)
    d = df.withColumn("__n", F.lead(isi).over(w))
    return d.groupBy(*keys).agg(F.avg(F.try_divide(F.col("__n") - F.col(isi), F.col("__n") + F.col(isi))).alias("adaptation"))


def interval_ratio(df: DataFrame, keys: list[str], order: list[str], x: str, last: int = 64) -> DataFrame:
    """Each gap over the median of the gaps before, `last` of them at most."""
    w = _w(keys, order)
    d = df.withColumn("gap", F.col(x) - F.lag(x).over(w))
    return d.withColumn("ratio", F.try_divide(F.col("gap"), F.percentile("gap", F.lit(0.5)).over(w.rowsBetween(-last, -1))))


def sliding_slope(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, k: int) -> DataFrame:
    """The first steepest run of k points: slope, and the x where it begins."""
    w = _w(keys, order).rowsBetween(0, k - 1)
    d = df.withColumn("slope", F.regr_slope(y, x).over(w)).withColumn("points", F.count("*").over(w)).where((F.col("points") == k) & F.col("slope").isNotNull())
    return d.groupBy(*keys).agg(F.max_by(F.struct("slope", x), F.struct(F.col("slope"), -F.col(x))).alias("r")).select(*keys, "r.slope", F.col(f"r.{x}").alias("from_x"))


def running_median(df: DataFrame, keys: list[str], order: list[str], y: str, half: int) -> DataFrame:
    return df.withColumn("running_median", F.percentile(y, F.lit(0.5)).over(_w(keys, order).rowsBetween(-half, half)))


def running_quantile(df: DataFrame, keys: list[str], order: list[str], y: str, window: int, q: float) -> DataFrame:
    """A baseline: at every ``window`` / 8 points and the last one the nearest-rank q-quantile of the finite values of a centred window, and lines between.

    A window is of 3 points at least, and of no more than the group has, if that is 3 or more; without finite values it gives 0.
    """
    w, whole = _w(keys, order), Window.partitionBy(*keys)
    d = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(whole))
    size = F.greatest(F.lit(3), F.least(F.lit(window), F.greatest("__n", F.lit(3))))
    d = d.withColumn("__half", F.floor(size / 2)).withColumn("__step", F.greatest(F.floor(size / 8), F.lit(1)))
    half = max(window, 3) // 2
    finite = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & (F.abs(y) != float("inf"))
    near = F.collect_list(F.when(finite, F.struct("__i", F.col(y).cast("double").alias("y")))).over(w.rowsBetween(-half, half))
    d = d.withColumn("__near", near).withColumn("__on", (F.col("__i") % F.col("__step") == 0) | (F.col("__i") == F.col("__n") - 1))
    d = d.withColumn("__v", F.when(F.col("__on"), F.expr("array_sort(transform(filter(__near, x -> abs(x.__i - __i) <= __half), x -> x.y))")))
    nearest = F.element_at("__v", (F.floor((F.size("__v") - 1) * q + 0.5) + 1).cast("int"))
    d = d.withColumn("__q", F.when(F.col("__on"), F.when(F.size("__v") > 0, nearest).otherwise(0.0)))
    point = F.when(F.col("__on"), F.struct("__i", F.col("__q").alias("q")))
    d = d.withColumn("__a", F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first(point, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    share = (F.col("__i") - F.col("__a.__i")) / (F.col("__b.__i") - F.col("__a.__i"))
    line = F.when(F.col("__on"), F.col("__q")).otherwise(F.col("__a.q") + (F.col("__b.q") - F.col("__a.q")) * share)
    return d.withColumn("baseline", line).drop("__i", "__n", "__half", "__step", "__near", "__on", "__v", "__q", "__a", "__b")


def difference_noise(df: DataFrame, keys: list[str], order: list[str], y: str) -> DataFrame:
    """median |dy| / 0.6745 / sqrt 2."""
    d = df.withColumn("__d", F.abs(F.col(y) - F.lag(y).over(_w(keys, order))))
    return d.groupBy(*keys).agg((F.median("__d") / 0.6745 / np.sqrt(2)).alias("noise"))


def savitzky_golay_weights(window: int, order: int = 2, derivative: int = 0) -> list[float]:
    half = window // 2
    x = np.arange(-half, half + 1)[:, None] ** np.arange(order + 1)
    return [float(v) for v in np.linalg.pinv(x)[derivative] * (1 if derivative < 2 else 2)]


def savitzky_golay(df: DataFrame, keys: list[str], order: list[str], y: str, window: int) -> DataFrame:
    """Quadratic smoothing over ``window`` points, an even number rounded up, under 5 none; towards the ends the window shrinks on both sides."""
    w, m = _w(keys, order), window // 2 if window >= 5 else 0
    d = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    half = F.least(F.lit(m), F.col("__i"), F.col("__n") - 1 - F.col("__i"))
    weights = [savitzky_golay_weights(2 * k + 1) if k > 1 else [0.0, 1.0, 0.0] if k else [1.0] for k in range(m + 1)]
    total: Column = F.lit(0.0)
    for j in range(-m, m + 1):
        at = F.lag(y, -j).over(w) if j < 0 else F.lead(y, j).over(w) if j > 0 else F.col(y)
        of = F.array(*(F.lit(weights[k][j + k] if abs(j) <= k else 0.0) for k in range(m + 1)))
        total = total + F.when(F.col("__half") >= abs(j), of[F.col("__half")] * at).otherwise(0.0)
    return d.withColumn("__half", half.cast("int")).withColumn("smooth", total).drop("__i", "__n", "__half")


def derivative(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, central: bool = False) -> DataFrame:
    w = _w(keys, order)
    if central:
        d = F.try_divide(F.lead(y).over(w) - F.lag(y).over(w), F.lead(x).over(w) - F.lag(x).over(w))
    else:
        d = F.try_divide(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x))
    return df.withColumn("derivative", d)


def local_maxima(df: DataFrame, keys: list[str], order: list[str], y: str, half: int, least: float | None = None) -> DataFrame:
    """Rows that are the first largest within `half` rows on both sides."""
    w = _w(keys, order)
    peak = (F.col(y) >= F.coalesce(F.max(y).over(w.rowsBetween(1, half)), F.col(y))) & (F.col(y) > F.coalesce(F.max(y).over(w.rowsBetween(-half, -1)), F.col(y) - 1))
    d = df.withColumn("__p", peak)
    return d.where(F.col("__p") & (F.col(y) >= least if least is not None else F.lit(True))).drop("__p")


def first_crossing(df: DataFrame, keys: list[str], x: str, y: str, threshold: Column) -> DataFrame:
    """The first x where y rises through the threshold and the next point holds; logarithmic between positive points, else linear."""
    w = _w(keys, [x])
    d = df.withColumns({"__t": threshold, "__py": F.lag(y).over(w), "__px": F.lag(x).over(w), "__ny": F.lead(y).over(w)})
    up = d.where((F.col("__py") < F.col("__t")) & (F.col(y) >= F.col("__t")) & (F.col("__ny") >= F.col("__t")))
    lin = F.try_divide(F.col("__t") - F.col("__py"), F.col(y) - F.col("__py"))
    log = F.try_divide(F.ln("__t") - F.ln("__py"), F.ln(y) - F.ln("__py"))
    at = F.col("__px") + (F.col(x) - F.col("__px")) * F.when(F.col("__py") > 0, log).otherwise(lin)
    return up.withColumn("cq", at).groupBy(*keys).agg(F.min_by("cq", x).alias("cq"))


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    w = _w(keys, [x])
    d = df.withColumn("__a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return d.groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("auc"))


def envelope(df: DataFrame, keys: list[str], order: list[str], y: str, buckets: int) -> DataFrame:
    """Smallest and largest value of each of so many equal runs."""
    return df.withColumn("bucket", F.ntile(buckets).over(_w(keys, order))).groupBy(*keys, "bucket").agg(F.min(y).alias("lo"), F.max(y).alias("hi"))


def shared_histogram(df: DataFrame, keys: list[str], value: str, low: float = 0.0005, high: float = 0.9995, log: bool = False) -> DataFrame:
    """Bins that all series (keys) share: keys, bin, start, end, height, empty bins too.

    The range is that of the values at the nearest ranks, equal ends widened by a half; bins are the root of the values per series, 24 to 160.
    Height is a count, of several series a percentage of the series' finite values. log: bins are equal in the logarithm, what is not positive is in none.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v) AND abs(__v) < double('inf')")
    v = v.withColumn("__x", F.when(F.col("__v") > 0, F.log10("__v")) if log else F.col("__v"))
    r = nearest_ranks(v, [], "__x", {"lo": low, "hi": high}).first()
    sizes = v.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else v.agg(F.count("*").alias("__n")).where("__n > 0")
    series = sizes.count()
    lo, hi = (r["lo"], r["hi"]) if r else (0.0, 0.0)
    lo, hi = (lo, hi) if hi > lo else (lo - 0.5, lo + 0.5)
    bins = min(160, max(24, int(((r["n"] if r else 0) / max(series, 1)) ** 0.5)))
    step = (hi - lo) / bins
    at = F.least(F.floor((F.col("__x") - lo) / step), F.lit(bins - 1))
    counts = v.where(F.col("__x").between(lo, hi)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("__c"))
    named = counts.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)} | {"bin": "__bin"})
    same = F.col("bin") == F.col("__bin")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    whole = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(named, same, "left")
    height = F.coalesce("__c", F.lit(0)) * (F.lit(100.0) / F.col("__n") if series > 1 else F.lit(1.0))
    back = lambda t: F.pow(F.lit(10.0), t) if log else t
    return whole.select(*keys, "bin", back(lo + F.col("bin") * step).alias("start"), back(lo + (F.col("bin") + 1) * step).alias("end"), height.alias("height"))


def trace_statistics(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """samples, finite, min, max, mean, population sd, and where the extremes lie."""
    v = F.when(~F.isnan(F.col(y).cast("double")) & (F.abs(F.col(y).cast("double")) != float("inf")), F.col(y).cast("double"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count(v).alias("finite"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min_by(x, F.struct(v.alias("v"), F.col(x))).alias("x_at_min"), F.max_by(x, F.struct(v.alias("v"), -F.col(x))).alias("x_at_max"),
    )


def pixel_statistics(df: DataFrame, keys: list[str], value: str, saturated: float) -> DataFrame:
    """count, extremes, mean, population sd, percentiles, shares of zero and saturated pixels."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        *(F.percentile(v, F.lit(p / 100)).alias(f"p{p}") for p in (1, 5, 50, 95, 99)),
        F.try_divide(F.count_if(v == 0), F.count(v)).alias("zero_fraction"), F.try_divide(F.count_if(v >= saturated), F.count(v)).alias("saturated_fraction"),
    )


def max_projection(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    return df.groupBy(*keep).agg(F.max(value).alias(value))


def plane_sum(df: DataFrame, keep: list[str], value: str) -> DataFrame:
    return df.groupBy(*keep).agg(F.sum(value).alias(value))


def parameter_summary(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """events, median, mean, sd, min, max per column."""
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "parameter", "v")
    return long.groupBy(*keys, "parameter").agg(F.count("v").alias("events"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))


def percent_of_total(df: DataFrame, keys: list[str], area: str) -> DataFrame:
    return df.withColumn("area_percent", F.try_divide(F.col(area) * 100, F.sum(area).over(Window.partitionBy(*keys))))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n and r of the rows that have both; null under two rows or without spread."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("r"))


def merged_statistics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of wells from those of their fields (count, mean, std of the population, min, max), pixels unread."""
    n = F.sum("count")
    mean = F.try_divide(F.sum(F.col("count") * F.col("mean")), n)
    square = F.try_divide(F.sum(F.col("count") * (F.col("std") ** 2 + F.col("mean") ** 2)), n)
    return parts.groupBy(*keys).agg(F.count("*").alias("fields"), n.alias("count"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"))
