"""Group summaries of tidy tables, with replicates, controls and two-sample tests.

One pass over the rows: values are unpivoted, the moments are partial aggregates, and
the control group is a broadcast-sized result joined back to the summary, not to the rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import semantics as S
from ..errors import UsageError
from ..functions import special

#: Columns that say what was measured, best first in each family.
DIMENSIONS = [
    ["channel_name", "channel"],
    ["parameter", "label"],
    ["population"],
    ["trace_name", "trace"],
    ["read"],
    ["wavelength_nm"],
    ["unit"],
    ["x_unit"],
    ["t"],
    ["table"],
]


def varying_dimensions(df: DataFrame, by: list[str], families: list[list[str]] | None = None) -> list[str]:
    """Of each family the first column that every row fills, if it varies: one aggregate for all."""
    families = families if families is not None else DIMENSIONS
    names = [c for f in families for c in f if c in df.columns]
    if not names:
        return []
    cells = [F.coalesce(F.bool_and(F.col(c).isNotNull()), F.lit(False)).alias(f"f{i}") for i, c in enumerate(names)]
    cells += [(F.min(F.col(c).cast("string")) != F.max(F.col(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(names)]
    row = df.agg(*cells).first()
    out = []
    for f in families:
        full = next((c for c in f if c in names and row[f"f{names.index(c)}"]), None)
        if full and row[f"v{names.index(full)}"] and full not in by and not any(c in by for c in f):
            out.append(full)
    return out


def describe(df: DataFrame, keys: list[str], value: str = "v", extra: list | None = None) -> DataFrame:
    """n, mean, sd (n - 1), sem, median, min, max, cv_percent of the finite values of a group."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), *(extra or []))
    return out.withColumn("sem", F.try_divide(F.col("sd"), F.sqrt(F.col("n").cast("double")))).withColumn("cv_percent", S.cv_percent(F.col("mean"), F.col("sd")))


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, value (column name), v: finite numbers only."""
    if len(values) == 1:
        out = df.select(*keys, F.lit(values[0]).alias("value"), S.as_number(df, values[0]).alias("v"))
    else:
        out = df.select(*keys, *(S.as_number(df, c).alias(c) for c in values)).unpivot(keys, values, "value", "v")
    return out.where("v is not null")


def summarize(df: DataFrame, by: list[str], values: list[str], *, replicate: str | None = None, control: str | None = None, control_column: str | None = None, test: str | None = None, exact_by: bool = False, families: list[list[str]] | None = None) -> DataFrame:
    """A row per group and value column.

    replicate: means per (group, replicate) are what is described, with n_rows beside;
    control: the group of control_column (the first of by) that others are compared with:
    difference, ratio and, with test 'welch' or 'mann-whitney', statistic, df and p_value.
    """
    if test and not control:
        raise UsageError("a test needs a control group")
    if "error" in df.columns:
        df = df.where("error is null")
    keys = [*by, *([] if exact_by else varying_dimensions(df, by, families))]
    rows = long_form(df, [*keys, *([replicate] if replicate else [])], values)
    group = [*keys, "value"]
    if replicate:
        rows = rows.groupBy(*group, replicate).agg(F.avg("v").alias("v"), F.count("v").alias("rows"))
        out = describe(rows, group, extra=[F.sum("rows").alias("n_rows")])
    else:
        out = describe(rows, group)
    order = [*group, "n", *(["n_rows"] if replicate else []), "mean", "sd", "sem", "median", "min", "max", "cv_percent"]
    out = out.select(*order)
    if not control:
        return out
    return compare(out, rows, group, control_column or by[0], control, test)


def _null_safe(a: str, b: str, keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def compare(summary: DataFrame, rows: DataFrame, group: list[str], column: str, control: str, test: str | None) -> DataFrame:
    """The summary with each group held against the control group of the same other keys."""
    rest = [k for k in group if k != column]
    base = summary.where(F.col(column).cast("string") == control).select(*rest, F.col("n").alias("cn"), F.col("mean").alias("cm"), F.col("sd").alias("cs"))
    out = summary.alias("a").join(base.alias("b"), _null_safe("a", "b", rest), "left").select("a.*", "cn", "cm", "cs")
    other = F.coalesce(F.col(column).cast("string") != control, F.lit(True)) & F.col("cn").isNotNull()
    out = out.withColumns({"control": F.when(other, F.lit(control)), "diff": F.when(other, F.col("mean") - F.col("cm")), "ratio": F.when(other, F.try_divide(F.col("mean"), F.col("cm")))})
    if test == "welch":
        a, b = F.try_divide(F.col("sd") ** 2, F.col("n")), F.try_divide(F.col("cs") ** 2, F.col("cn"))
        ok = other & (F.col("n") >= 2) & (F.col("cn") >= 2) & (a + b > 0)
        df = F.try_divide((a + b) ** 2, F.try_divide(a**2, F.col("n") - 1) + F.try_divide(b**2, F.col("cn") - 1))
        out = out.withColumns({"statistic": F.when(ok, F.try_divide(F.col("mean") - F.col("cm"), F.sqrt(a + b))), "df": F.when(ok, df)})
        out = out.withColumns({"p_value": _t_p(F.col("statistic"), F.col("df")), "method": F.when(ok, F.lit("welch"))})
    elif test == "mann-whitney":
        u = mann_whitney(rows, group, column, control)
        out = out.alias("a").join(u.alias("u"), _null_safe("a", "u", group), "left").select("a.*", "u.statistic", F.lit(None).cast("double").alias("df"), "u.p_value", F.when(F.col("u.statistic").isNotNull(), "mann-whitney").alias("method"))
    elif test:
        raise UsageError(f"no test {test}", "welch or mann-whitney")
    return out.drop("cn", "cm", "cs")


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.t_two_sided(a, b) if a == a and b == b and a is not None and b is not None else None for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _u_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([special.mann_whitney_p(a, int(b), int(c), d) for a, b, c, d in zip(u, n1, n2, ties, strict=True)], dtype=float)


def mann_whitney(rows: DataFrame, group: list[str], column: str, control: str) -> DataFrame:
    """(group, statistic U of the group, n1, n2, p_value) against the control of the same other keys.

    Values are first counted per distinct value and group, so ranks come from running counts
    over distinct values: rows that share a value cost one row.
    """
    rest = [k for k in group if k != column]
    counts = rows.groupBy(*group, "v").agg(F.count("*").alias("c"))
    is_control = F.col(column).cast("string") == control
    ctrl = counts.where(is_control).select(*rest, "v", F.col("c").alias("cc"))
    cases = counts.where(~S.holds(is_control))
    # every case group over the union of its values and the control's
    names = cases.select(*group).distinct()
    base = names.alias("g").join(ctrl.alias("c"), _null_safe("g", "c", rest)).select("g.*", "c.v", F.lit(0).cast("long").alias("c"), "c.cc")
    both = cases.withColumn("cc", F.lit(0).cast("long")).unionByName(base).groupBy(*group, "v").agg(F.sum("c").alias("c"), F.sum("cc").alias("cc"))
    w = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("c") + F.col("cc")
    ranked = both.withColumn("rank", F.coalesce(F.sum(t).over(w), F.lit(0)) + (t + 1) / 2)
    td = t.cast("double")
    out = ranked.groupBy(*group).agg(F.sum("c").alias("n1"), F.sum("cc").alias("n2"), F.sum(F.col("rank") * F.col("c")).alias("r1"), F.sum(td * td * td - td).alias("ties"))
    out = out.where("n1 > 0 and n2 > 0").withColumn("statistic", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    return out.withColumn("p_value", _u_p("statistic", "n1", "n2", "ties")).drop("r1", "ties")


#: The columns that are summarised unless told otherwise, by measure.
PRIMARY = {
    "stats": ["mean", "median"],
    "trace": ["mean", "max"],
    "table": ["median", "value"],
    "gate": ["count", "percent_of_parent"],
    "peaks": ["area", "height", "main_area", "main_area_percent"],
    "chromatogram": ["apex_rt_min", "apex_intensity"],
    "assay": ["value", "back_calculated", "final_concentration", "ec50", "max_slope_per_min", "doubling_time_h", "z_prime", "mean"],
    "nmr-peaks": ["ppm", "height", "value", "main_peak_ppm"],
    "ephys-features": ["spike_count", "rheobase_pa", "input_resistance_mohm", "peak_mv"],
    "spikes": ["spike_count", "rate_hz"],
    "qpcr": ["cq", "rq", "efficiency_percent"],
    "well-stats": ["mean", "median"],
}


def primary_values(measure: str, df: DataFrame) -> list[str]:
    """The columns of a measure's table that a summary takes by default; without any, all numbers that are values and no dimensions."""
    wanted = [c for c in PRIMARY.get(measure, []) if c in df.columns]
    wanted += [c for c in df.columns if measure == "gate" and c.startswith("median:")]
    dimensions = {c for family in DIMENSIONS for c in family}
    return wanted or [f.name for f in df.schema if isinstance(f.dataType, S.NUMERIC) and f.metadata.get("role", "value") == "value" and f.name not in dimensions]
