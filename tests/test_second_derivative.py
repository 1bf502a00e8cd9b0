import math
import random

import numpy as np
import pytest

from fathomry.operators import qpcr


def by_fits(x, y):
    """The rule with numpy's least squares; None: can't be analysed, False: no Cq."""
    n = len(x)
    if n < 18 or any(v is None or not math.isfinite(v) for v in y) or any(abs(a - i - 1) > 1e-9 for i, a in enumerate(x)):
        return None
    bx, by = np.array(x[2:15]), np.array(y[2:15])
    sd = np.std(by - np.polyval(np.polyfit(bx, by, 1), bx), ddof=1)
    if max(y) - by.mean() <= 50 * sd:
        return False
    t = np.arange(-4, 5)
    second = [2 * np.polyfit(t, np.array(y[i - 4 : i + 5]) - y[i], 2)[0] for i in range(4, n - 4)]
    peak = max(range(len(second)), key=lambda i: (second[i], i))
    if second[peak] <= 0:
        return False
    if peak < 3 or peak + 4 > len(second):
        return None
    a, b, _ = np.polyfit(np.arange(-3, 4), second[peak - 3 : peak + 4], 2)
    return x[peak + 4] - b / (2 * a) if a < 0 and abs(b / (2 * a)) <= 3 else None


@pytest.fixture(scope="module")
def curves():
    r = random.Random(2)
    curve = lambda n, mid, top, noise, k=1.5: [100 + 0.2 * i + top / (1 + math.exp((mid - i) / k)) + r.gauss(0, noise) for i in range(1, n + 1)]
    out = {f"rise {i}": curve(40, r.uniform(20, 33), r.uniform(500, 3000), 0.3) for i in range(12)}
    out |= {"flat": curve(40, 25, 0, 1.0), "short": curve(17, 10, 900, 0.1), "late": curve(40, 39, 2000, 0.1), "early": curve(40, 3, 2000, 0.1), "falls": [1000 - 3.0 * i for i in range(40)], "high": [1e9 + v for v in curve(40, 26, 2000, 0.3)]}
    out["gap"] = curve(40, 25, 900, 0.1)
    out["nan"] = [*curve(30, 25, 900, 0.1)[:20], float("nan"), *curve(30, 25, 900, 0.1)[21:]]
    out["inf"] = [*curve(30, 25, 900, 0.1)[:-1], float("inf")]
    out["null"] = [None, *curve(30, 25, 900, 0.1)[1:]]
    return out


def test_like_fits(spark, curves):
    rows = [(k, float(i + 1 + (k == "gap" and i > 20)), v) for k, y in curves.items() for i, v in enumerate(y)]
    random.Random(1).shuffle(rows)
    got = {r["k"]: (r["outcome"], r["cq"]) for r in qpcr.second_derivative_cq(spark.createDataFrame(rows, "k string, cycle double, fluorescence double"), ["k"]).collect()}
    for k, y in curves.items():
        want = by_fits([i + 1.0 + (k == "gap" and i > 20) for i in range(len(y))], y)
        outcome, cq = got[k]
        assert outcome == ("undetermined" if want is None else "none" if want is False else "cq"), k
        assert (cq is None) == (outcome != "cq") and (cq is None or math.isclose(cq, want, abs_tol=1e-3 if k == "high" else 1e-6)), k
    assert {o for o, _ in got.values()} == {"cq", "none", "undetermined"} and got["flat"][0] == "none" and got["rise 3"][0] == "cq"


def test_nothing(spark):
    assert qpcr.second_derivative_cq(spark.createDataFrame([], "k string, cycle double, fluorescence double"), ["k"]).count() == 0
