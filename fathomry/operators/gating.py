"""Flow cytometry: compensation, transforms, gates as boolean columns, population tables.

A strategy is compiled to expressions in parent order, so all events take one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Gate:
    """kind: rectangle {col: (lo, hi)}, polygon (x, y, vertices), ellipsoid (cols, mean, covariance, distance2), boolean (op, names), complement (name)."""

    name: str
    kind: str
    spec: object
    parent: str | None = None
    extra: dict = field(default_factory=dict, hash=False, compare=False)


def compensate(df: DataFrame, channels: list[str], spill: list[list[float]]) -> DataFrame:
    """raw * inverse(spill), one linear combination per channel."""
    inv = np.linalg.inv(np.array(spill, float))
    return df.withColumns({c: reduce(lambda a, b: a + b, [F.col(k) * float(inv[i, j]) for i, k in enumerate(channels)]) for j, c in enumerate(channels)})


def unmix(df: DataFrame, detectors: list[str], spectra: dict[str, list[float]]) -> DataFrame:
    """Least squares of the detectors on the dyes' spectra."""
    m = np.linalg.pinv(np.array(list(spectra.values()), float).T)
    return df.withColumns({n: reduce(lambda a, b: a + b, [F.col(d) * float(m[i, k]) for k, d in enumerate(detectors)]) for i, n in enumerate(spectra)})


def linear(c: Column, t: float, a: float = 0.0) -> Column:
    return (c + a) / (t + a)


def logarithmic(c: Column, t: float, m: float) -> Column:
    return F.when(c > 0, F.log10(c / t) / m + 1)


def arcsinh(c: Column, t: float, m: float, a: float) -> Column:
    return (F.asinh(c * float(np.sinh(m * np.log(10)) / t)) + a * float(np.log(10))) / float((m + a) * np.log(10))


def cofactor_arcsinh(c: Column, cofactor: float = 5.0) -> Column:
    return F.asinh(c / cofactor)


def logicle_values(y: np.ndarray, t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> np.ndarray:
    """Inverse of the biexponential a e^{bx} - c e^{-dx} + f, by bisected Newton steps on all values at once."""
    b = (m + a) * np.log(10)
    w_ = w / (m + a)
    x2 = a / (m + a)
    x1 = x2 + w_
    x0 = x2 + 2 * w_
    lo, hi = 1e-12, b
    if w_ > 0:
        for _ in range(200):
            d = (lo + hi) / 2
            lo, hi = (d, hi) if 2 * (np.log(d) - np.log(b)) + w_ * (b + d) < 0 else (lo, d)
        d = (lo + hi) / 2
    else:
        d = b
    ca = np.exp(x0 * (b + d))
    fa = np.exp(b * x1) - ca / np.exp(d * x1)
    sa = t / ((np.exp(b) - fa) - ca / np.exp(d))
    return _inverse(lambda x: sa * (np.exp(b * x) - ca * np.exp(-d * x) - fa), y)


def _inverse(rising: Callable[[np.ndarray], np.ndarray], y: np.ndarray) -> np.ndarray:
    """Where a rising function takes the values y, between -2 and 3: all bisected at once."""
    lo, hi = np.full(len(y), -2.0), np.full(len(y), 3.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = rising(x) < y
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return (lo + hi) / 2


def hyperlog_values(y: np.ndarray, t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> np.ndarray:
    """Inverse of a e^{bx} + cx - f, which is linear about 0 over w decades and takes t at 1."""
    b = (m + a) * np.log(10)
    zero, top = (a + w) / (m + a), (a + 2 * w) / (m + a)
    slope = np.exp(b * top) * (m + a) / w
    offset = np.exp(b * zero) + slope * zero
    scale = t / (np.exp(b) + slope - offset)
    return _inverse(lambda x: scale * (np.exp(b * x) + slope * x - offset), y)


def _mapped(c: Column, values: Callable[[np.ndarray], np.ndarray]) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(s: pd.Series) -> pd.Series:
        v = s.to_numpy(float)
        out = np.full(len(v), np.nan)
        ok = np.isfinite(v)
        out[ok] = values(v[ok])
        return pd.Series(out).where(ok)

    return run(c)


def logicle(c: Column, t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> Column:
    return _mapped(c, lambda v: logicle_values(v, t, w, m, a))


def hyperlog(c: Column, t: float = 262144.0, w: float = 0.5, m: float = 4.5, a: float = 0.0) -> Column:
    return _mapped(c, lambda v: hyperlog_values(v, t, w, m, a))


def offset_log(c: Column, offset: float, decades: float) -> Column:
    """Decades over the offset, below which all is 0, as a share of the scale's."""
    return (F.log10(F.greatest(c, F.lit(float(offset)))) - float(np.log10(offset))) / decades


def ratio(x: Column, y: Column, a: float = 1.0, b: float = 0.0, c: float = 0.0) -> Column:
    """a (x - b) / (y - c), a dimension of its own; null where y is c."""
    return F.try_divide(a * (x - b), y - c)


def match_samples(files: DataFrame, samples: DataFrame) -> DataFrame:
    """(file, sample): the one sample of the file's name, else of its `fil`, else the only one there is; otherwise null.

    files: file, fil; samples: sample, name, uri_name, fil.
    """

    def only(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.where(f"{key} is not null and {key} <> ''").distinct().groupBy(key).agg(F.min("sample").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")

    named = only(samples.select("sample", F.explode(F.array("name", "uri_name")).alias("file")), "file", "__named")
    kept = only(samples.select("sample", F.trim("fil").alias("__fil")), "__fil", "__kept")
    single = samples.agg(F.when(F.count("*") == 1, F.min("sample")).alias("__single"))
    out = files.withColumn("__fil", F.trim("fil")).join(named, "file", "left").join(kept, "__fil", "left").crossJoin(F.broadcast(single))  # one row
    return out.select("file", F.coalesce("__named", "__kept", "__single").alias("sample"))


def _number(c: str) -> Column:
    d = F.col(c).cast("double")
    return F.when(~F.isnan(d), d)


def polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Odd number of edges crossed to the right; the bounding box comes first."""
    xs, ys = [v[0] for v in vertices], [v[1] for v in vertices]
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if y0 != y1:
            at = F.lit(float(x0)) + (y - float(y0)) * float((x1 - x0) / (y1 - y0))
            crossings = crossings + (((y >= min(y0, y1)) & (y < max(y0, y1))) & (x < at)).cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


def member(gate: Gate, columns: dict[str, Column]) -> Column:
    s = gate.spec
    if gate.kind == "rectangle":
        tests = [(_number(c) >= lo if lo is not None else F.lit(True)) & (_number(c) < hi if hi is not None else F.lit(True)) for c, (lo, hi) in s.items()]
        out = reduce(lambda a, b: a & b, tests)
    elif gate.kind == "polygon":
        out = polygon(_number(s[0]), _number(s[1]), s[2])
    elif gate.kind == "ellipsoid":
        cols, mean, cov, d2 = s
        inv = np.linalg.inv(np.array(cov, float))
        out = reduce(lambda a, b: a + b, [(_number(c) - mean[i]) * (_number(k) - mean[j]) * float(inv[i, j]) for i, c in enumerate(cols) for j, k in enumerate(cols)]) <= d2
    elif gate.kind == "boolean":
        op, names = s
        out = reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), [columns[n] for n in names])
        out = ~out if op == "not" else out
    else:
        out = ~columns[s]
    out = F.coalesce(out, F.lit(False))
    return out & columns[gate.parent] if gate.parent else out


def quadrants(name: str, x: str, y: str, cx: float, cy: float, parent: str | None = None) -> list[Gate]:
    return [Gate(f"{name}{i}", "rectangle", {x: bx, y: by}, parent) for i, (bx, by) in enumerate([((None, cx), (cy, None)), ((cx, None), (cy, None)), ((cx, None), (None, cy)), ((None, cx), (None, cy))], 1)]


def apply_gates(df: DataFrame, gates: list[Gate]) -> DataFrame:
    """A 0/1 column `gate:<name>` per population; parents come before children."""
    columns: dict[str, Column] = {}
    for g in gates:
        columns[g.name] = F.col(f"`gate:{g.name}`") == 1
        df = df.withColumn(f"gate:{g.name}", member(g, columns).cast("int"))
    return df


def populations(df: DataFrame, gates: list[Gate], keys: list[str], medians: list[str] | None = None) -> DataFrame:
    """keys, population, parent, count, percent_of_parent, percent_of_total, median:<parameter>: one aggregate."""
    gated = apply_gates(df, gates)
    cols = [F.count("*").alias("__all")]
    for g in gates:
        cols.append(F.sum(f"`gate:{g.name}`").alias(f"n:{g.name}"))
        cols += [F.median(F.when(F.col(f"`gate:{g.name}`") == 1, F.col(m))).alias(f"m:{g.name}:{m}") for m in medians or []]
    wide = gated.groupBy(*keys).agg(*cols)
    rows = F.explode(F.array(*(F.struct(
        F.lit(g.name).alias("population"), F.lit(g.parent).alias("parent"), F.col(f"`n:{g.name}`").alias("count"),
        F.try_divide(F.col(f"`n:{g.name}`") * 100.0, F.col(f"`n:{g.parent}`") if g.parent else F.col("__all")).alias("percent_of_parent"),
        F.try_divide(F.col(f"`n:{g.name}`") * 100.0, F.col("__all")).alias("percent_of_total"),
        *(F.col(f"`m:{g.name}:{m}`").alias(f"median:{m}") for m in medians or []),
    ) for g in gates)))
    return wide.select(*keys, rows.alias("r")).select(*keys, "r.*")
