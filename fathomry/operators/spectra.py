"""Spectra as rows of (mz, intensity) arrays: chromatograms, peaks, transitions, bands.

Sums and maxima fold the arrays in place; nothing is exploded unless the result is long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(mz: str = "mz", intensity: str = "intensity") -> Column:
    return F.zip_with(mz, intensity, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity")))


def _total(points: Column) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, x: a + x["intensity"])


def chromatograms(scans: DataFrame, targets: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Per scan: tic, bpc and its m/z, and for each target (lo, hi) the summed intensity: one pass for all."""
    s = scans.withColumn("__p", pairs())
    base = F.aggregate("__p", F.struct(F.lit(None).cast("double").alias("mz"), F.lit(None).cast("double").alias("intensity")), lambda a, x: F.when(a["intensity"].isNull() | (x["intensity"] > a["intensity"]), x).otherwise(a))
    out = {"tic": _total(F.col("__p")), "__b": base}
    for name, (lo, hi) in (targets or {}).items():
        out[name] = _total(F.filter("__p", _between(lo, hi)))
    return s.withColumns(out).withColumns({"bpc": F.col("__b.intensity"), "base_peak_mz": F.col("__b.mz")}).drop("__p", "__b")


def _between(lo: float, hi: float):
    return lambda x: (x["mz"] >= lo) & (x["mz"] <= hi)


def transitions(scans: DataFrame, products: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Per name (precursor, product, tolerance): intensity of the product's nearest point, where the precursor fits."""
    s = scans.withColumn("__p", pairs())
    cols = {}
    for name, (q1, q3, tol) in products.items():
        near = F.filter("__p", _between(q3 - tol, q3 + tol))
        best = F.array_min(F.transform(near, _distance(q3)))
        cols[name] = F.when(F.abs(F.col("precursor_mz") - q1) <= tol, F.coalesce(best["intensity"], F.lit(0.0)))
    return s.withColumns(cols).drop("__p")


def _distance(q: float):
    return lambda x: F.struct(F.abs(x["mz"] - q).alias("d"), x["intensity"].alias("intensity"))


def top_peaks(scans: DataFrame, n: int, by_mz: bool = False) -> DataFrame:
    """The n most intense points of each scan, ties to the smaller m/z; by_mz: back in m/z order."""
    ranked = F.array_sort(F.transform(pairs(), lambda x: F.struct((-x["intensity"]).alias("o"), x["mz"].alias("mz"), x["intensity"].alias("intensity"))))
    best = F.slice(ranked, 1, n)
    best = F.array_sort(F.transform(best, lambda x: F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity")))) if by_mz else F.transform(best, lambda x: F.struct(x["mz"].alias("mz"), x["intensity"].alias("intensity")))
    return scans.withColumn("peaks", best)


def thinned(scans: DataFrame, key: list[str], slices: int) -> DataFrame:
    """The most intense point of each of so many equal m/z slices."""
    p = scans.select(*key, F.explode(pairs()).alias("p")).select(*key, "p.*")
    w = Window.partitionBy(*key)
    lo, hi = F.min("mz").over(w), F.max("mz").over(w)
    cut = F.least(F.coalesce(F.floor(F.try_divide((F.col("mz") - lo) * slices, hi - lo)), F.lit(0)), F.lit(slices - 1))
    return p.withColumn("slice", cut).groupBy(*key, "slice").agg(F.max_by(F.struct("mz", "intensity"), F.struct("intensity", -F.col("mz"))).alias("p")).select(*key, "slice", "p.*")


#: The mass steps of an isotope and a proton in Da; tolerances in parts and in Da; least heights of higher and lower isotopes.
ISOTOPE, PROTON = 1.003355, 1.007276
TOLERANCE = 15e-6, 0.003
HIGHER, LOWER = 0.02, 0.05

CHARGE = "mz double, intensity double, charge int, isotopes int, monoisotopic_mz double, neutral_mass double"


def charges(scans: DataFrame, n: int = 20, most: int = 8, polarity: str = "positive") -> DataFrame:
    """scan and ``CHARGE`` of the strongest peaks, from isotope spacing; charge 0 if unknown."""
    schema = pa.schema([("scan", pa.int64()), ("mz", pa.float64()), ("intensity", pa.float64()), ("charge", pa.int32()), ("isotopes", pa.int32()), ("monoisotopic_mz", pa.float64()), ("neutral_mass", pa.float64())])

    def values(column) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().fill_null(0).to_numpy()

    def run(batches):
        for b in batches:
            (mz, m), (y, k) = values(b.column(1)), values(b.column(2))
            m_at, y_at = np.cumsum(m) - m, np.cumsum(k) - k
            out = []
            for i, scan in enumerate(b.column(0).to_pylist()):
                size = min(int(m[i]), int(k[i]))
                out += [{"scan": scan, **p} for p in isotope_charges(mz[m_at[i] : m_at[i] + size], y[y_at[i] : y_at[i] + size], n, most, polarity)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return scans.select(F.col("scan").cast("long").alias("scan"), "mz", "intensity").mapInArrow(run, "scan long, " + CHARGE)


def isotope_charges(mz: np.ndarray, y: np.ndarray, n: int, most: int, polarity: str = "positive") -> list[dict]:
    """The strongest centroids, but for those within the isotope pattern of one already listed.

    The charge is that whose spacing finds most higher isotopes in a row, six at most, the smaller one if equal. The
    pattern begins at its lowest isotope, monoisotopic_mz (the peak's own where there is none lower).
    """
    ok = np.isfinite(mz) & (y > 0)
    order = np.argsort(mz[ok], kind="stable")
    mz, y = mz[ok][order], y[ok][order]

    def found(at: np.ndarray, least: float) -> np.ndarray:
        """Which of the places have a point of that height within tolerance."""
        tol = np.maximum(TOLERANCE[0] * at, TOLERANCE[1])
        lo, hi = np.searchsorted(mz, at - tol, "left"), np.searchsorted(mz, at + tol, "right")
        return np.array([bool((y[a:b] >= least).any()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])

    def run_of(hits: np.ndarray) -> int:
        return len(hits) if hits.all() else int(np.argmin(hits))

    z = np.arange(1, most + 1)
    taken = np.zeros(0)
    out: list[dict] = []
    for i in np.argsort(-y, kind="stable"):
        if len(out) >= n:
            break
        at, height = float(mz[i]), float(y[i])
        if len(taken) and (np.abs(taken - at) <= max(TOLERANCE[0] * at, TOLERANCE[1])).any():
            continue
        higher = found((at + np.arange(1, 7)[None, :] * ISOTOPE / z[:, None]).ravel(), HIGHER * height).reshape(most, 6)
        runs = np.array([run_of(h) for h in higher])
        best = int(np.argmax(runs))
        charge = int(z[best]) if runs[best] else 0
        mono = at - ISOTOPE / charge * run_of(found(at - np.arange(1, 7) * ISOTOPE / charge, LOWER * height)) if charge else at
        mass = charge * (mono - PROTON if polarity == "positive" else mono + PROTON) if charge else None
        taken = np.append(taken, mono + np.arange(9) * ISOTOPE / max(charge, 1))
        out.append({"mz": at, "intensity": height, "charge": charge, "isotopes": int(runs[best]), "monoisotopic_mz": mono, "neutral_mass": mass})
    return out


def level_counts(scans: DataFrame, keys: list[str], level: str = "ms_level") -> DataFrame:
    """Scans and points of each level."""
    return scans.groupBy(*keys, level).agg(F.count("*").alias("scans"), F.sum(F.size("mz")).alias("points"))


def bands(points: DataFrame, keys: list[str], x: str, y: str, lo: float, hi: float, baseline: bool = True) -> DataFrame:
    """Area of [lo, hi] by trapezoids above the line between its ends, its centroid and largest value."""
    w = Window.partitionBy(*keys).orderBy(x)
    p = points.where(F.col(x).between(lo, hi))
    ends = Window.partitionBy(*keys)
    x0, x1 = F.min(x).over(ends), F.max(x).over(ends)
    y0, y1 = F.min_by(y, x).over(ends), F.max_by(y, x).over(ends)
    line = y0 + F.coalesce(F.try_divide((y1 - y0) * (F.col(x) - x0), x1 - x0), F.lit(0.0)) if baseline else F.lit(0.0)
    p = p.withColumn("__v", F.col(y) - line)
    p = p.withColumn("__a", (F.col(x) - F.lag(x).over(w)) * (F.col("__v") + F.lag("__v").over(w)) / 2)
    return p.groupBy(*keys).agg(F.coalesce(F.sum("__a"), F.lit(0.0)).alias("area"), F.try_divide(F.sum(F.col(x) * F.col("__v")), F.sum("__v")).alias("centroid"), F.max("__v").alias("height"))
