"""qPCR: thresholds, relative quantities, standard curves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import savitzky_golay_weights


def cq_of(cycle: np.ndarray, y: np.ndarray, threshold: float | None = None) -> tuple[float | None, float | None]:
    """(Cq, threshold): a baseline line is taken off, the threshold is ten of its deviations unless given."""

    def attempt(end: int):
        win = (cycle >= 3) & (cycle <= end)
        if win.sum() < 3:
            win = np.arange(len(cycle)) < max(3, len(cycle) // 4)
        if win.sum() < 3 or len(cycle) < 5:
            return None
        slope, icpt = np.polyfit(cycle[win], y[win], 1)
        c = y - (slope * cycle + icpt)
        thr = threshold if threshold is not None else 10 * c[win].std(ddof=1)
        if not thr > 0:
            return None
        for i in range(1, len(c)):
            if c[i - 1] < thr <= c[i] and (c[i + 1 : i + 2] >= thr).all():
                if threshold is None and not (y[i:] - y[win].mean() >= thr).any():
                    continue
                f = (np.log(thr) - np.log(c[i - 1])) / (np.log(c[i]) - np.log(c[i - 1])) if c[i - 1] > 0 else (thr - c[i - 1]) / (c[i] - c[i - 1])
                return float(cycle[i - 1] + (cycle[i] - cycle[i - 1]) * f), float(thr)
        return None

    got = None
    for end in (15, 12, 9, 7, 5, 4):
        got = attempt(end)
        if got:
            break
    for _ in range(3):
        if not got or got[0] - 3 <= 5:
            break
        again = attempt(int(got[0] - 3))
        if not again or abs(again[0] - got[0]) < 1e-9:
            break
        got = again
    return got or (None, None)


def threshold_cq(df: DataFrame, keys: list[str], cycle: str = "cycle", y: str = "fluorescence", threshold: float | None = None) -> DataFrame:
    """keys, cq, threshold: a reaction is some dozens of cycles, so a group is small."""
    names = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna().sort_values(cycle)
        return pd.DataFrame([[*key, *cq_of(p[cycle].to_numpy(float), p[y].to_numpy(float), threshold)]], columns=[*keys, "cq", "threshold"])

    return df.select(*keys, cycle, y).groupBy(*keys).applyInPandas(run, ", ".join([*names, "cq double, threshold double"]))


#: Cycles of the baseline, its standard deviations that a curve must rise above it, and the fewest cycles.
BASELINE, GATE_SDS, LEAST_CYCLES = (3, 15), 50.0, 18


def second_derivative_cq(df: DataFrame, keys: list[str], cycle: str = "cycle", y: str = "fluorescence") -> DataFrame:
    """keys, outcome, cq: the cycle where a curve's second derivative is largest, by windows alone.

    The derivative is that of a quadratic through nine readings; one through the seven derivatives around the largest (of equals the last) puts the
    maximum between cycles. outcome: ``cq``; ``none`` where the curve stays within the gate or never turns up; ``undetermined`` where it can't be
    analysed: under 18 cycles, not numbered 1, 2, 3, ..., a missing or infinite reading, a maximum too near an end or without an apex.
    """
    d = df.select(*keys, F.col(cycle).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("x")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    d = d.withColumn("in_turn", finite(F.col("y")) & finite(F.col("x")) & (F.abs(F.col("x") - F.row_number().over(ordered)) <= 1e-9))
    base = F.col("x").between(BASELINE[0] - 0.5, BASELINE[1] + 0.5)
    bx, by = F.when(base, F.col("x")), F.when(base, F.col("y"))
    d = d.withColumns({"slope": F.regr_slope(by, bx).over(whole), "start": F.regr_intercept(by, bx).over(whole), "level": F.avg(by).over(whole)})
    d = d.withColumn("left", F.when(base, F.col("y") - F.col("start") - F.col("slope") * F.col("x")))

    def around(column: str, weights: list[float], middle: Column | None = None) -> Column:
        """The weighted sum of a row and those beside it, null at the ends."""
        total: Column = F.lit(0.0)
        half = len(weights) // 2
        for j, c in zip(range(-half, half + 1), weights, strict=True):
            at = F.lag(column, -j).over(ordered) if j < 0 else F.lead(column, j).over(ordered) if j else F.col(column)
            total = total + c * (at - middle if middle is not None else at)
        return total

    # weights add up to nothing: taking the middle reading off keeps a large background out of the sum
    d = d.withColumn("second", around("y", savitzky_golay_weights(9, 2, 2), F.col("y")))
    d = d.withColumns({"tilt": around("second", savitzky_golay_weights(7, 2, 1)), "bend": around("second", [c / 2 for c in savitzky_golay_weights(7, 2, 2)])})
    top = F.max_by(F.struct("x", "second", "tilt", "bend"), F.when(finite(F.col("second")), F.struct("second", "x"))).alias("top")
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and("in_turn").alias("fit"), F.stddev_samp("left").alias("sd"), F.first("level").alias("level"), F.max("y").alias("highest"), top)
    offset = -F.col("top.tilt") / (2 * F.col("top.bend"))
    usable = F.col("fit") & (F.col("n") >= LEAST_CYCLES) & finite(F.col("sd")) & finite(F.col("level"))
    flat = (F.col("highest") - F.col("level") <= GATE_SDS * F.col("sd")) | F.coalesce(F.col("top.second") <= 0, F.lit(False))
    apex = F.coalesce((F.col("top.bend") < 0) & (F.abs(offset) <= 3.0), F.lit(False))
    outcome = F.when(~F.coalesce(usable, F.lit(False)), "undetermined").when(flat, "none").when(apex, "cq").otherwise("undetermined")
    return g.select(*keys, outcome.alias("outcome"), F.when(outcome == "cq", F.col("top.x") + offset).alias("cq"))


def delta_delta_cq(df: DataFrame, references: list[str], calibrator: str, sample: str = "sample", target: str = "target", cq: str = "cq") -> DataFrame:
    """delta Cq against the mean of the references' means, delta delta Cq against the calibrator, rq and its range."""
    per = df.where(F.col(cq).isNotNull()).groupBy(sample, target).agg(F.avg(cq).alias("mean_cq"), F.coalesce(F.stddev_samp(cq), F.lit(0.0)).alias("sd_cq"), F.count(cq).alias("n"))
    ref = per.where(F.col(target).isin(references)).groupBy(sample).agg(F.avg("mean_cq").alias("ref_cq"), (F.sqrt(F.sum(F.col("sd_cq") ** 2)) / F.count("*")).alias("ref_sd"))
    d = per.where(~F.col(target).isin(references)).join(ref, sample)
    d = d.withColumn("delta_cq", F.col("mean_cq") - F.col("ref_cq")).withColumn("sd", F.sqrt(F.col("sd_cq") ** 2 + F.col("ref_sd") ** 2))
    cal = d.where(F.col(sample).cast("string") == calibrator).select(target, F.col("delta_cq").alias("cal"))
    d = d.join(cal, target, "left").withColumn("ddcq", F.col("delta_cq") - F.col("cal"))
    return d.select(sample, target, "n", "mean_cq", "delta_cq", "sd", "ddcq", F.pow(F.lit(2.0), -F.col("ddcq")).alias("rq"), F.pow(F.lit(2.0), -F.col("ddcq") - F.col("sd")).alias("rq_min"), F.pow(F.lit(2.0), -F.col("ddcq") + F.col("sd")).alias("rq_max"))


def pfaffl(df: DataFrame, references: list[str], calibrator: str, sample: str = "sample", target: str = "target", cq: str = "cq", efficiency: str = "efficiency") -> DataFrame:
    """E ** delta Cq of the target over the geometric mean of the references'; null unless every E is in (1, 2.5]."""
    per = df.groupBy(sample, target).agg(F.avg(cq).alias("m"), F.avg(efficiency).alias("e"))
    cal = per.where(F.col(sample).cast("string") == calibrator).select(target, F.col("m").alias("cm"))
    r = per.join(cal, target).withColumn("q", F.when((F.col("e") > 1) & (F.col("e") <= 2.5), (F.col("cm") - F.col("m")) * F.ln("e")))
    ref = r.where(F.col(target).isin(references)).groupBy(sample).agg(F.when(F.bool_and(F.col("q").isNotNull()), F.avg("q")).alias("rq"))
    return r.where(~F.col(target).isin(references)).join(ref, sample).select(sample, target, F.exp(F.col("q") - F.col("rq")).alias("ratio"))


def standard_curve(df: DataFrame, keys: list[str], quantity: str = "quantity", cq: str = "cq") -> DataFrame:
    """slope, intercept, r2 and efficiency (%) of Cq over log10 quantity, from two levels on."""
    d = df.where((F.col(quantity) > 0) & F.col(cq).isNotNull()).withColumn("__l", F.log10(quantity))
    out = d.groupBy(*keys).agg(F.count_distinct("__l").alias("levels"), F.regr_slope(cq, "__l").alias("slope"), F.regr_intercept(cq, "__l").alias("intercept"), F.regr_r2(cq, "__l").alias("r2")).where("levels >= 2")
    return out.withColumn("efficiency", F.when(F.col("slope") != 0, (F.pow(F.lit(10.0), F.try_divide(F.lit(-1.0), F.col("slope"))) - 1) * 100))
