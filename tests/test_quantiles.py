import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.operators import quantiles, series


def groups(seed=1):
    r = random.Random(seed)
    out = {"flat": [7.0] * 500, "two": [1.0] * 300 + [2.0] * 300, "few": [3.0, float("nan"), None, 1.0], "wild": [10.0 ** r.randint(-300, 300) * r.choice([-1, 1]) for _ in range(700)], None: [r.gauss(0, 1) for _ in range(900)]}
    out["ties"] = [float(r.randint(0, 3)) for _ in range(800)] + [float("inf"), float("-inf"), -0.0]
    return out


@pytest.mark.parametrize("small", [1, 40, 10_000])
def test_like_sorting(spark, small):
    g = groups()
    rows = [(k, v) for k, vs in g.items() for v in vs]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    names = {"lo": 0.0, "a": 0.01, "mid": 0.5, "z": 0.9995, "hi": 1.0}
    got = {r["k"]: r for r in quantiles.nearest_ranks(df, ["k"], "v", names, small).collect()}
    for k, vs in g.items():
        s = sorted(v for v in vs if v is not None and v == v)
        assert got[k]["n"] == len(s)
        for name, p in names.items():
            assert got[k][name] == s[math.floor((len(s) - 1) * p + 0.5)], (k, name)
    smooth = {r["k"]: r for r in quantiles.quantiles(df.where("k <> 'ties' or k is null"), ["k"], "v", {"q": 0.37, "m": 0.5}, small).collect()}
    for k in ("flat", "two", "few", None):
        s = [v for v in g[k] if v is not None and v == v]
        assert math.isclose(smooth[k]["m"], float(np.quantile(s, 0.5)), rel_tol=1e-12) and math.isclose(smooth[k]["q"], float(np.quantile(s, 0.37)), rel_tol=1e-9, abs_tol=1e-12)


def test_no_keys_and_nothing(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert quantiles.nearest_ranks(df, [], "v", {"m": 0.5}, 10).first()["m"] == 500.0
    assert quantiles.nearest_ranks(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def baseline(y, window, q):
    n = len(y)
    window = min(max(window, 3), max(n, 3))
    half, step = window // 2, max(window // 8, 1)
    grid = [*range(0, n - 1, step), n - 1]

    def at(i):
        s = sorted(v for v in y[max(i - half, 0) : i + half + 1] if math.isfinite(v))
        return s[math.floor((len(s) - 1) * q + 0.5)] if s else 0.0

    return np.interp(range(n), grid, [at(i) for i in grid]).tolist()


def test_smoothing_and_baselines_at_the_ends(spark):
    r = random.Random(3)
    data = {"a": [r.gauss(0, 1) for _ in range(60)], "b": [r.random() for _ in range(5)], "c": [1.0], "d": [r.random() for _ in range(2)], "e": [float("nan")] * 4}
    df = spark.createDataFrame([(k, i, v) for k, y in data.items() for i, v in enumerate(y)], "k string, i int, v double")
    rows = lambda d, c: {k: [x[c] for x in sorted((x for x in got if x["k"] == k), key=lambda x: x["i"])] for k in data for got in [d]}
    for window in (16, 3, 40):
        got = rows(series.running_quantile(df, ["k"], ["i"], "v", window, 0.25).collect(), "baseline")
        for k, y in data.items():
            assert np.allclose(got[k], baseline(y, window, 0.25), atol=1e-12), (window, k)
    for window in (4, 5, 6, 7, 11):
        got = rows(series.savitzky_golay(df, ["k"], ["i"], "v", window).collect(), "smooth")
        m = window // 2 if window >= 5 else 0
        for k in "abcd":
            y = data[k]
            for i in range(len(y)):
                h = min(m, i, len(y) - 1 - i)
                want = np.polyval(np.polyfit(range(-h, h + 1), y[i - h : i + h + 1], 2), 0) if h > 1 else y[i]
                assert math.isclose(got[k][i], want, abs_tol=1e-9), (window, k, i)


def test_shared_histogram(spark):
    r = random.Random(5)
    rows = [("a", r.gauss(5, 2)) for _ in range(3000)] + [("b", r.gauss(9, 1)) for _ in range(100)] + [("a", None), ("b", float("nan")), ("b", -1e9), ("a", 0.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for log in (False, True):
        got = series.shared_histogram(df, ["k"], "v", log=log).collect()
        vals = {k: [v for j, v in rows if j == k and v is not None and v == v] for k in "ab"}
        shown = sorted(math.log10(v) if log else v for vs in vals.values() for v in vs if not log or v > 0)
        at = lambda p: shown[math.floor((len(shown) - 1) * p + 0.5)]  # noqa: B023, E731
        lo, hi = at(0.0005), at(0.9995)
        bins = min(160, max(24, int((len(shown) / 2) ** 0.5)))
        assert len(got) == 2 * bins
        for k, vs in vals.items():
            xs = [math.log10(v) if log else v for v in vs if not log or v > 0]
            want = [0.0] * bins
            for x in xs:
                if lo <= x <= hi:
                    want[min(int((x - lo) / ((hi - lo) / bins)), bins - 1)] += 100.0 / len(vs)
            have = {x["bin"]: x["height"] for x in got if x["k"] == k}
            assert np.allclose([have[i] for i in range(bins)], want)
    one = series.shared_histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), [], "v").collect()
    assert sum(x["height"] for x in one) == 3.0 and len(one) == 24 and min(x["start"] for x in one) == 4.5
    assert series.shared_histogram(df.limit(0), ["k"], "v").count() == 0
