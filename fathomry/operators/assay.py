"""Plate assays: replicate groups, outliers, blanks, curves, inverse prediction, kinetics, growth, quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special

MODELS = {"linear": 2, "4pl": 4, "5pl": 5}


def group_key(df: DataFrame) -> Column:
    """What makes wells replicates: group, else sample, else compound and concentration, else role."""
    parts = []
    for c in ("group", "sample"):
        if c in df.columns:
            parts.append(F.col(c).cast("string"))
    if {"compound", "concentration"} <= set(df.columns):
        parts.append(F.concat_ws("@", "compound", F.col("concentration").cast("string")))
    return F.coalesce(*parts, F.col("role"))


def outliers(df: DataFrame, keys: list[str], value: str, method: str = "grubbs", alpha: float = 0.05) -> DataFrame:
    """A column `outlier`: at most one per group, by Grubbs' test (n >= 3) or a modified z over 3.5 (n >= 5)."""
    w = Window.partitionBy(*keys)
    v = F.col(value)
    if method == "grubbs":
        d = F.abs(v - F.avg(v).over(w))
        g = F.try_divide(d, F.stddev_samp(v).over(w))
        df = df.withColumn("__n", F.count(v).over(w)).withColumn("__g", g)

        def critical(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                yield pd.DataFrame({"__size": p["__size"], "__limit": [special.grubbs_critical(int(n), alpha) for n in p["__size"]]})

        # one value for each size that occurs
        limits = df.select(F.col("__n").alias("__size")).where("__size >= 3").distinct().mapInPandas(critical, "__size long, __limit double")
        df = df.join(limits, F.col("__n") == F.col("__size"), "left")
        suspect = F.col("__g") > F.col("__limit")
        score = F.col("__g")
    else:
        d = df.withColumn("__m", F.median(value).over(w))
        df = d.withColumn("__d", F.abs(F.col(value) - F.col("__m"))).withColumn("__mad", F.median("__d").over(w))
        score = F.try_divide(0.6745 * F.col("__d"), F.col("__mad"))
        suspect = (F.count(v).over(w) >= 5) & (score > 3.5)
    first = F.row_number().over(w.orderBy(score.desc_nulls_last(), v)) == 1
    return df.withColumn("outlier", F.coalesce(suspect & first, F.lit(False))).drop("__m", "__d", "__mad", "__n", "__g", "__size", "__limit")


def subtract_blank(df: DataFrame, keys: list[str], value: str, how: str = "mean") -> DataFrame:
    """value minus the blank wells' mean or median of the same plate and time."""
    blank = df.where("role = 'blank'").groupBy(*keys).agg((F.avg if how == "mean" else F.median)(value).alias("__b"))
    return df.join(blank, keys, "left").withColumn("corrected", F.col(value) - F.coalesce("__b", F.lit(0.0))).drop("__b")


def reduce_kinetic(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """first, last, min, max, mean, mean_slope, auc of each well's reads."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = df.withColumn("__a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return d.groupBy(*keys).agg(F.min_by(y, x).alias("first"), F.max_by(y, x).alias("last"), F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"), F.regr_slope(y, x).alias("mean_slope"), F.coalesce(F.sum("__a"), F.lit(0.0)).alias("auc"))


def quality(df: DataFrame, keys: list[str], value: str, role: str = "role", group: list[str] | None = None) -> DataFrame:
    """Z' of positive against negative wells with its assessment, Z-factor of the samples, signal to background and noise, SSMD.

    group: the columns that make wells replicates; with them, the median CV of groups of two wells or more.
    """
    v, pos, neg, smp = F.col(value), F.col(role) == "positive", F.col(role) == "negative", F.col(role) == "sample"
    stats = [f(F.when(which, v)).alias(name) for name, f, which in (("mp", F.avg, pos), ("sp", F.stddev_samp, pos), ("mn", F.avg, neg), ("sn", F.stddev_samp, neg), ("ms", F.avg, smp), ("ss", F.stddev_samp, smp))]
    z = 1 - F.try_divide(3 * (F.col("sp") + F.col("sn")), F.abs(F.col("mp") - F.col("mn")))
    out = df.groupBy(*keys).agg(*stats).select(
        *keys,
        z.alias("z_prime"),
        F.when(z >= 0.5, "excellent").when(z > 0, "marginal").when(z.isNotNull(), "unusable").alias("assessment"),
        (1 - F.try_divide(3 * (F.col("ss") + F.col("sn")), F.abs(F.col("ms") - F.col("mn")))).alias("z_factor"),
        F.try_divide(F.col("mp"), F.col("mn")).alias("signal_to_background"),
        F.try_divide(F.col("mp") - F.col("mn"), F.col("sn")).alias("signal_to_noise"),
        F.try_divide(F.col("mp") - F.col("mn"), F.sqrt(F.col("sp") ** 2 + F.col("sn") ** 2)).alias("ssmd"),
    )
    if not group:
        return out
    cv = df.groupBy(*keys, *group).agg(F.try_divide(F.stddev_samp(v), F.abs(F.avg(v))).alias("__cv")).groupBy(*keys).agg((F.median("__cv") * 100).alias("median_replicate_cv_percent"))
    return out.join(cv, keys, "left")


def percent_effect(df: DataFrame, keys: list[str], value: str, role: str = "role") -> DataFrame:
    """100 * (value - negative mean) / (positive mean - negative mean) per plate."""
    w = Window.partitionBy(*keys)
    n, p = (F.avg(F.when(F.col(role) == r, F.col(value))).over(w) for r in ("negative", "positive"))
    return df.withColumn("effect", F.try_divide((F.col(value) - n) * 100, p - n))


def _bend(model: str, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(1 + (x / c) ** b) ** g: what a and d don't move."""
    b, c = p[..., 1, None], p[..., 2, None]
    with np.errstate(all="ignore"):
        v = 1 + np.where(x > 0, (np.maximum(x, 1e-300) / abs(c)) ** b, 0.0)
        return v ** p[..., 4, None] if model == "5pl" else v


def curve(model: str, p: np.ndarray, x: np.ndarray, bend: np.ndarray | None = None) -> np.ndarray:
    """linear: a + b x; 4pl and 5pl: d + (a - d) / (1 + (x / c) ** b) ** g; of parameters (..., p) at points (..., n)."""
    if model == "linear":
        return p[..., 0, None] + p[..., 1, None] * x
    a, d = p[..., 0, None], p[..., 3, None]
    with np.errstate(all="ignore"):
        return d + (a - d) / (_bend(model, p, x) if bend is None else bend)


def weights_of(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    v = {"none": np.ones_like(y), "1/y": np.abs(y), "1/y2": y**2, "1/x": np.abs(x), "1/x2": x**2}[kind]
    return np.where(v > 0, 1 / np.where(v > 0, v, 1), 0.0) if kind != "none" else v


def jacobian(f, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """By central differences."""
    steps = np.diag(np.maximum(1e-6, 1e-6 * np.abs(p)))
    return np.stack([(f(p + h, x) - f(p - h, x)) / (2 * h.max()) for h in steps], 1)


def slopes(f, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``jacobian`` of many fits: (fits, points, parameters); f is told which parameter is moved."""
    out = np.empty((*x.shape, p.shape[1]))
    for i, h in enumerate(np.maximum(1e-6, 1e-6 * np.abs(p)).T):
        up, down = p.copy(), p.copy()
        up[:, i] += h
        down[:, i] -= h
        out[..., i] = (f(up, x, i) - f(down, x, i)) / (2 * h[:, None])
    return out


def _curve_slopes(model: str, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    bend = _bend(model, p, x)  # stays where a or d is moved
    return slopes(lambda q, t, i: curve(model, q, t, bend if i in (0, 3) else None), p, x)


def _solved(a: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solutions of many systems, NaN where one is singular."""
    try:
        return np.linalg.solve(a, g[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full_like(g, np.nan)
        return np.concatenate([_solved(a[i : i + 1], g[i : i + 1]) for i in range(len(a))])


def levenberg(f, p0: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 300, positive: tuple[int, ...] = (), jac=None) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of many fits at once, with a numeric Jacobian; parameters named positive stay so.

    p0: (fits, parameters); x, y and weights w: (fits, points); f of many, as ``curve``. Parameters and costs of each fit, which
    takes its own steps until it has settled and is then left out; a Jacobian holds until a step is taken.
    """
    jac = jac or (lambda q, t: slopes(lambda s, z, _: f(s, z), q, t))
    k = p0.shape[1]
    best, costs = p0.astype(float), np.empty(len(p0))
    p, lam, at, moved = best.copy(), np.full(len(p0), 1e-3), np.arange(len(p0)), np.ones(len(p0), bool)
    a, g = np.empty((len(p0), k, k)), np.empty((len(p0), k))
    with np.errstate(all="ignore"):
        r = y - f(p, x)
        cost = (w * r * r).sum(1)
        for _ in range(rounds):
            if not len(at):
                break
            if moved.any():
                j = jac(p[moved], x[moved])
                jt = np.swapaxes(j, 1, 2)
                a[moved], g[moved] = jt @ (w[moved][..., None] * j), (jt @ (w[moved] * r[moved])[..., None])[..., 0]
            damped = a.copy()
            damped[:, range(k), range(k)] += lam[:, None] * np.maximum(a[:, range(k), range(k)], 1e-12)
            q = p + _solved(damped, g)
            inside = np.isfinite(q).all(1) & (q[:, list(positive)] > 0).all(1)
            rq = y - f(np.where(inside[:, None], q, p), x)
            cq = np.where(inside, (w * rq * rq).sum(1), np.inf)
            moved = np.isfinite(cq) & (cq < cost)
            stop = np.where(moved, cost - cq < 1e-14 * np.maximum(cost, 1e-300), lam * 10 > 1e12)
            p, r, cost = np.where(moved[:, None], q, p), np.where(moved[:, None], rq, r), np.where(moved, cq, cost)
            lam = np.where(moved, np.maximum(lam / 10, 1e-12), lam * 10)
            if stop.any():
                best[at[stop]], costs[at[stop]] = p[stop], cost[stop]
                p, r, cost, lam, at, moved, a, g, x, y, w = (v[~stop] for v in (p, r, cost, lam, at, moved, a, g, x, y, w))
    best[at], costs[at] = p, cost
    return best, costs


#: Fits at once: so many points of all starts together, of series of nearly one length.
FITTED_AT_ONCE, LONGER = 1 << 16, 1.25


def _together(lengths: list[int], starts: int) -> Iterator[list[int]]:
    """Places of the series that are fitted at once."""
    block: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if block and (lengths[i] > LONGER * lengths[block[0]] or (len(block) + 1) * lengths[i] * starts > FITTED_AT_ONCE):
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def _best(f, starts: list[list[np.ndarray]], xs: list[np.ndarray], ys: list[np.ndarray], ws: list[np.ndarray], positive: tuple[int, ...], jac=None) -> list[tuple[np.ndarray, float]]:
    """Parameters and cost of each series from the best of its starts; shorter series are filled with their first point, of weight 0."""
    out: list = [None] * len(xs)
    for block in _together([len(x) for x in xs], max(map(len, starts), default=1)):
        n, k = len(xs[block[-1]]), len(starts[block[0]])
        full = lambda vs, fill: np.repeat(np.stack([np.concatenate([vs[i], np.full(n - len(vs[i]), fill(vs[i]))]) for i in block]), k, 0)  # noqa: B023, E731
        first, none = (lambda v: v[0]), (lambda v: 0.0)
        p, cost = levenberg(f, np.concatenate([np.stack(starts[i]) for i in block]), full(xs, first), full(ys, first), full(ws, none), positive=positive, jac=jac)
        p, cost = p.reshape(len(block), k, -1), cost.reshape(len(block), k)
        for b, i in enumerate(block):
            least = min(range(k), key=lambda s: cost[b, s])  # noqa: B023
            out[i] = p[b, least], float(cost[b, least])
    return out


def fit_curve(model: str, x: np.ndarray, y: np.ndarray, weighting: str = "none") -> dict | None:
    return fit_curves(model, [(x, y)], weighting)[0]


def fit_curves(model: str, series: list[tuple[np.ndarray, np.ndarray]], weighting: str = "none") -> list[dict | None]:
    """Of each series (x, y): parameters with standard errors and covariance, r2, sse, residual_se, degrees of freedom; None with too few distinct x.

    The covariance is residual_se^2 (J' W J)^-1; there is none without degrees of freedom or for a singular fit.
    """
    out: list[dict | None] = [None] * len(series)
    todo, xs, ys, ws, starts = [], [], [], [], []
    for i, (x, y) in enumerate(series):
        ok = np.isfinite(x) & np.isfinite(y)
        x, y = x[ok], y[ok]
        if len(np.unique(x)) < MODELS[model] or (model != "linear" and not (x > 0).any()):
            continue
        todo.append(i)
        xs.append(x)
        ys.append(y)
        ws.append(weights_of(weighting, x, y))
        if model != "linear":
            low, high, mid = y[x == x.min()].mean(), y[x == x.max()].mean(), np.exp(np.log(x[x > 0]).mean())
            starts.append([np.array([low, b, m, high] + ([1.0] if model == "5pl" else [])) for b in (1.0, 2.0, 0.5) for m in (mid, mid / 10, mid * 10)])
    if model == "linear":
        fits = []
        for x, y, w in zip(xs, ys, ws, strict=True):
            a = np.stack([np.ones_like(x), x], 1) * np.sqrt(w)[:, None]
            p = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
            fits.append((p, float((w * (y - curve(model, p, x)) ** 2).sum())))
    else:
        fits = _best(lambda q, t: curve(model, q, t), starts, xs, ys, ws, (1, 2, 4) if model == "5pl" else (1, 2), lambda q, t: _curve_slopes(model, q, t))
    for i, x, y, w, (p, cost) in zip(todo, xs, ys, ws, fits, strict=True):
        out[i] = _described(model, x, y, w, p, cost)
    return out


def _described(model: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, p: np.ndarray, cost: float) -> dict:
    mean = (w * y).sum() / w.sum() if w.sum() > 0 else y.mean()
    total, df = float((w * (y - mean) ** 2).sum()), max(len(x) - len(p), 0)
    cov, s2 = None, cost / df if df else None
    j = jacobian(lambda q, t: curve(model, q, t), p, x)
    if df and np.isfinite(j).all():
        scale = np.sqrt(np.maximum((w[:, None] * j * j).sum(0), 1e-300))
        info = j.T @ (w[:, None] * j) / np.outer(scale, scale)
        if np.linalg.matrix_rank(info) == len(p):
            cov = s2 * np.linalg.inv(info) / np.outer(scale, scale)
    se = np.sqrt(np.maximum(np.diag(cov), 0)) if cov is not None else None
    return {"p": p, "se": se, "cov": cov, "r2": 1.0 if total == 0 else 1 - cost / total, "sse": cost, "residual_se": None if s2 is None else float(np.sqrt(s2)), "df": df, "n": len(x), "levels": len(np.unique(x)), "x_min": float(x.min()), "x_max": float(x.max())}


def _finite_point() -> Column:
    return (F.abs("__x") < np.inf) & (F.abs("__y") < np.inf)  # NaN is above infinity


def by_series(df: DataFrame, keys: list[str], x: str, y: str, usable: Column, of: Callable[[list[tuple[np.ndarray, np.ndarray]]], list[dict]], columns: str) -> DataFrame:
    """keys and columns: what ``of`` makes of the usable points (``__x``, ``__y``) of each group, a small one, in their order; of many groups at once.

    The groups are dealt over all shuffle partitions: they are few bytes and much work, so that merging partitions by their size would leave it to a few tasks.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    given = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    d = df.select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    # a group without usable points has a row, too
    point = lambda c: F.collect_list(F.when(usable, F.struct("__x", "__y")))[c]
    # one more: Spark would drop a shuffle for an earlier one by the same keys and number, which it may merge
    groups = d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *keys).groupBy(*keys).agg(point("__x").alias("__x"), point("__y").alias("__y"))
    kinds = {c.split()[0]: {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in columns.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (b.column(b.schema.get_field_index(c)) for c in ("__x", "__y"))
            cuts = np.cumsum(u.value_lengths().to_numpy(zero_copy_only=False))[:-1]
            u, v = (c.flatten().to_numpy(zero_copy_only=False) for c in (u, v))
            series = []
            for s, t in zip(np.split(u, cuts), np.split(v, cuts), strict=True):
                order = np.lexsort((t, s))
                series.append((s[order], t[order]))
            got = of(series) if b.num_rows else []
            made = [pa.array([None if (value := g.get(c)) is None else value for g in got], kinds[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), *made], names=[*keys, *names])

    return groups.mapInArrow(run, ", ".join([*given, columns]))


PARAMETERS = ("a", "b", "c", "d", "g")
FIT = ", ".join([*(f"{p} double" for p in PARAMETERS), *(f"se_{p} double" for p in PARAMETERS), "r2 double", "sse double", "residual_se double", "df int", "n int", "levels int", "x_min double", "x_max double"])


def fit(df: DataFrame, keys: list[str], x: str, y: str, model: str = "4pl", weighting: str = "none") -> DataFrame:
    """A fitted curve per group (a standard curve's or compound's points: small groups); unweighted lines are sums, of groups of any size.

    Columns: the parameters, their standard errors, r2, sse, residual_se, df, n points, levels and range of x; nulls where
    there are too few levels of x. A line is a + b x.
    """
    names = [f.split()[0] for f in FIT.split(", ")]
    if model == "linear" and weighting == "none":
        u, v = F.col(x).cast("double"), F.col(y).cast("double")
        finite = df.select(*keys, F.when(F.abs(u) < np.inf, u).alias("__x"), F.when(F.abs(v) < np.inf, v).alias("__y"))  # NaN is above infinity
        both = F.col("__x").isNotNull() & F.col("__y").isNotNull()
        x_, y_ = F.when(both, F.col("__x")), F.when(both, F.col("__y"))
        sums = {"n": F.count(x_).cast("int"), "levels": F.count_distinct(x_).cast("int"), "x_min": F.min(x_), "x_max": F.max(x_), "a": F.regr_intercept(y_, x_), "b": F.regr_slope(y_, x_), "r2": F.regr_r2(y_, x_)}
        sums |= {"__sxx": F.regr_sxx(y_, x_), "__syy": F.regr_syy(y_, x_), "__sxy": F.regr_sxy(y_, x_), "__mx": F.regr_avgx(y_, x_)}
        out = finite.groupBy(*keys).agg(*(c.alias(name) for name, c in sums.items()))
        line = F.col("x_min") < F.col("x_max")
        sse = F.greatest(F.col("__syy") - F.try_divide(F.col("__sxy") * F.col("__sxy"), F.col("__sxx")), F.lit(0.0))
        free = F.greatest(F.col("n") - 2, F.lit(0))
        s2 = F.when(free > 0, F.try_divide(sse, free))
        errors = {"se_a": F.sqrt(s2 * (1 / F.col("n") + F.try_divide(F.col("__mx") * F.col("__mx"), F.col("__sxx")))), "se_b": F.sqrt(F.try_divide(s2, F.col("__sxx"))), "sse": sse, "residual_se": F.sqrt(s2), "df": free.cast("int")}
        none = F.lit(None).cast("double")
        return out.select(*keys, *(F.when(line, errors.get(c, F.col(c) if c in sums else none)).alias(c) for c in names))

    def of(series: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
        rows = []
        for got in fit_curves(model, series, weighting):
            row = dict(zip(PARAMETERS, got["p"])) if got else {}  # noqa: B905
            if got and got["se"] is not None:
                row |= {f"se_{c}": v for c, v in zip(PARAMETERS, got["se"])}  # noqa: B905
            rows.append(row | {c: got[c] for c in names[10:]} if got else row)
        return rows

    return by_series(df, keys, x, y, _finite_point(), of, FIT)


def inverse(y: Column, model: str = "4pl", at: dict[str, Column] | None = None) -> Column:
    """x at y from the fit's columns (at: where they have other names); null beyond the curve's ends."""
    a, b, c, d, g = (at[p] if at else F.col(p) for p in PARAMETERS)
    if model == "linear":
        return F.try_divide(y - a, b)
    inner = F.pow(F.try_divide(a - d, y - d), 1 / F.coalesce(g, F.lit(1.0))) - 1
    inside = (y > F.least(a, d)) & (y < F.greatest(a, d))
    return F.when(inside & (inner > 0), c * F.pow(inner, 1 / b))


def back_calculate(df: DataFrame, fits: DataFrame, keys: list[str], y: str, model: str = "4pl", nominal: str | None = None, dilution: str | None = None) -> DataFrame:
    """df with concentration, flag, final_concentration and (with nominal) recovery_percent, by the row of ``fit`` for keys.

    flag: in_range, below_range or above_range of the standards, below_curve or above_curve where the signal is
    beyond an asymptote, not_computable where the curve is flat or missing; null for a null signal.
    """
    names = [f.split()[0] for f in FIT.split(", ")]
    own = {c: f"__{c}" for c in names}
    curves = fits.select(*keys, *(F.col(c).alias(own[c]) for c in names))
    d = df.join(curves, keys, "left")
    at = {c: F.col(own[c]) for c in names}
    v = F.col(y)
    flat = (at["b"].isNull() | (at["b"] == 0)) if model == "linear" else (at["b"].isNull() | (at["a"] == at["d"]))
    low, high = F.least(at["a"], at["d"]), F.greatest(at["a"], at["d"])
    conc = F.when(~flat, inverse(v, model, at))
    flag = F.when(v.isNull(), None).when(flat, "not_computable")
    if model != "linear":
        flag = flag.when(v <= low, "below_curve").when(v >= high, "above_curve")
    flag = flag.when(F.col("__conc") < at["x_min"], "below_range").when(F.col("__conc") > at["x_max"], "above_range").when(F.col("__conc").isNotNull(), "in_range").otherwise("not_computable")
    d = d.withColumn("__conc", conc).withColumn("flag", flag)
    d = d.withColumn("final_concentration", F.col("__conc") * (F.coalesce(F.col(dilution), F.lit(1.0)) if dilution else F.lit(1.0)))
    if nominal:
        d = d.withColumn("recovery_percent", F.try_divide(F.col("__conc") * 100, F.col(nominal)))
    return d.withColumnRenamed("__conc", "back_calculated").drop(*own.values())


def quantification_limits(standards: DataFrame, fits: DataFrame, keys: list[str], nominal: str, y: str, model: str = "4pl", within: float = 20.0) -> DataFrame:
    """keys, lloq, uloq: the lowest and highest standards whose mean signal reads back within 20 % of nominal, with a CV of at most 20 %.

    A level of one well has no CV and counts by its recovery alone; null where no level holds.
    """
    v = F.col(y)
    levels = standards.where(F.col(nominal) > 0).groupBy(*keys, nominal).agg(F.avg(v).alias("__mean"), (F.try_divide(F.stddev_samp(v), F.abs(F.avg(v))) * 100).alias("__cv"))
    d = back_calculate(levels, fits, keys, "__mean", model, nominal)
    good = (F.abs(F.col("recovery_percent") - 100) <= within) & (F.coalesce("__cv", F.lit(0.0)) <= within)
    return d.groupBy(*keys).agg(F.min(F.when(good, F.col(nominal))).alias("lloq"), F.max(F.when(good, F.col(nominal))).alias("uloq"))


DOSE = "ec50 double, kind string, ec50_ci_low double, ec50_ci_high double, log10_ec50 double, absolute_ec50 double, hill_slope double, top double, bottom double, response_at_zero double, response_at_infinity double, min_concentration double, max_concentration double, extrapolated boolean, r2 double, n int, error string"


def midpoint(p: np.ndarray, share: float = 0.5) -> float:
    """The x where a logistic curve has gone this share of the way from its response at zero to that at infinity."""
    g = p[4] if len(p) > 4 else 1.0
    return float(p[2] * ((1 - share) ** (-1 / g) - 1) ** (1 / p[1]))


def effect_of(x: np.ndarray, y: np.ndarray, model: str = "4pl", confidence: float = 0.95, normalized: bool = False) -> dict:
    """The columns ``DOSE`` of one compound; the interval of the EC50 comes by the delta method on the scale of logarithms."""
    return _effect(fit_curve(model, x, y), x, model, confidence, normalized)


def _effect(got: dict | None, x: np.ndarray, model: str, confidence: float, normalized: bool) -> dict:
    if got is None:
        return {"error": f"needs {MODELS[model]} concentrations"}
    p, (low, high) = got["p"], sorted((got["p"][0], got["p"][3]))
    out = {"min_concentration": min(v for v in x if v > 0), "max_concentration": got["x_max"], "n": got["n"], "r2": got["r2"]}
    if not np.isfinite(p).all() or low == high:
        return out | {"error": "the fit is flat"}
    ec50, rises = midpoint(p), p[3] > p[0]
    if not (np.isfinite(ec50) and ec50 > 0):
        return out | {"error": "the fit has no midpoint"}
    if got["cov"] is not None:
        grad = jacobian(lambda q, _: np.array([np.log(midpoint(q))]), p, x)[0] if len(p) > 4 else np.array([0, 0, 1 / p[2], 0])
        half = special.t_quantile(0.5 + confidence / 2, got["df"]) * float(np.sqrt(max(grad @ got["cov"] @ grad, 0.0)))
        if half < 700:
            out |= {"ec50_ci_low": ec50 * np.exp(-half), "ec50_ci_high": ec50 * np.exp(half)}
    if normalized and low < 50 < high:
        out["absolute_ec50"] = midpoint(p, (50 - p[0]) / (p[3] - p[0]))
    return out | {
        "ec50": ec50, "kind": "EC50" if rises else "IC50", "log10_ec50": float(np.log10(ec50)), "hill_slope": p[1] if rises else -p[1],
        "top": high, "bottom": low, "response_at_zero": p[0], "response_at_infinity": p[3],
        "extrapolated": not out["min_concentration"] <= ec50 <= out["max_concentration"],
    }


def dose_response(df: DataFrame, keys: list[str], dose: str, response: str, model: str = "4pl", confidence: float = 0.95, normalized: bool = False) -> DataFrame:
    """IC50 or EC50 with its interval, Hill slope and plateaus per compound; a compound's wells are a small group.

    normalized: the responses are percent effects (``percent_effect``); then absolute_ec50 is where the curve crosses 50.
    """

    def of(series: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
        return [_effect(got, x, model, confidence, normalized) for got, (x, _) in zip(fit_curves(model, series), series, strict=True)]

    return by_series(df.where(F.col(dose) >= 0), keys, dose, response, _finite_point(), of, DOSE)


def kinetics(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """vmax, lag, t_vmax, auc per well; the window is a tenth of the points, five at least."""
    names = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=[x, y]).sort_values(x, kind="stable")
        t, v = p[x].to_numpy(float), p[y].to_numpy(float)
        n = len(t)
        out = [None, None, None, None]
        if n >= 2:
            h = int(min(max(max(5, -(-n // 10)), 2), n))
            tw, vw = np.lib.stride_tricks.sliding_window_view(t, h), np.lib.stride_tricks.sliding_window_view(v, h)
            tm, vm = tw.mean(1), vw.mean(1)
            sxx = ((tw - tm[:, None]) ** 2).sum(1)
            slope = np.where(sxx > 0, ((tw - tm[:, None]) * (vw - vm[:, None])).sum(1) / np.where(sxx > 0, sxx, 1), -np.inf)
            i = int(np.argmax(slope))
            base = v[: i + h].min()
            out = [slope[i], tm[i] - (vm[i] - base) / slope[i] if slope[i] > 0 else None, tm[i], float(((t[1:] - t[:-1]) * (v[1:] + v[:-1]) / 2).sum())]
        return pd.DataFrame([[*key, *out]], columns=[*keys, "vmax", "lag", "t_vmax", "auc"])

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(run, ", ".join([*names, "vmax double, lag double, t_vmax double, auc double"]))


def logistic(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """k / (1 + (k / n0 - 1) exp(-r x)); parameters and points as of ``curve``."""
    k, r, n0 = (p[..., i, None] for i in range(3))
    return k / (1 + (k / n0 - 1) * np.exp(np.clip(-r * x, -700, 700)))


def growth_of(t: np.ndarray, v: np.ndarray, window: int | None = None, share: float = 0.05) -> dict:
    return growths([(t, v)], window, share)[0]


def growths(series: list[tuple[np.ndarray, np.ndarray]], window: int | None = None, share: float = 0.05) -> list[dict]:
    """mu_max, doubling, lag, k, r, n0 of each well's values in time order.

    The window counts all points: a tenth of them, five at least; without as many points over the threshold
    (share of the maximum), or without a rising window, there is no rate. k, r, n0: the logistic curve from the first point on.
    """
    out = [_growth_rate(t, v, window, share) for t, v in series]
    todo, starts = [], []
    for i, (t, v) in enumerate(series):
        if len(t) >= 4 and v.max() > 0 and t[-1] > t[0]:
            rate = out[i].get("mu_max") or 4 / (t[-1] - t[0])
            todo.append(i)
            starts.append([np.array([v.max() * k, rate * f, max(v[0], 1e-3 * v.max())]) for k in (1.0, 1.2) for f in (1.0, 0.5, 2.0)])
    xs, ys = [series[i][0] - series[i][0][0] for i in todo], [series[i][1] for i in todo]
    for i, (q, _) in zip(todo, _best(logistic, starts, xs, ys, [np.ones_like(y) for y in ys], (0, 1, 2)), strict=True):
        out[i] |= dict(zip(("k", "r", "n0"), q, strict=True))
    return out


def _growth_rate(t: np.ndarray, v: np.ndarray, window: int | None, share: float) -> dict:
    n = len(t)
    if n < 2 or not v.max() > 0:
        return {}
    thr = share * v.max()
    h = max(window or max(5, -(-n // 10)), 2)
    keep = v > thr
    tk, lk = t[keep], np.log(v[keep])
    if len(tk) < h:
        return {}
    tw, lw = np.lib.stride_tricks.sliding_window_view(tk, h), np.lib.stride_tricks.sliding_window_view(lk, h)
    tm, lm = tw.mean(1), lw.mean(1)
    sxx = ((tw - tm[:, None]) ** 2).sum(1)
    mu = np.where(sxx > 0, ((tw - tm[:, None]) * (lw - lm[:, None])).sum(1) / np.where(sxx > 0, sxx, 1), -np.inf)
    i = int(np.argmax(mu))
    return {"mu_max": mu[i], "doubling": np.log(2) / mu[i], "lag": tm[i] - (lm[i] - np.log(max(v[:3].mean(), thr))) / mu[i]} if mu[i] > 0 else {}


def growth(df: DataFrame, keys: list[str], x: str, y: str, window: int | None = None) -> DataFrame:
    """``growths`` of the wells, small groups."""
    known = ~F.isnan(F.col("__x")) & ~F.isnan(F.col("__y")) & F.col("__x").isNotNull() & F.col("__y").isNotNull()
    return by_series(df, keys, x, y, known, lambda series: growths(series, window), "mu_max double, doubling double, lag double, k double, r double, n0 double")
