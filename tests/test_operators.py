import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry import semantics as S
from fathomry.errors import UsageError
from fathomry.operators import assay, catalog, gating, health, joins, layout, link, qpcr, series, signal, spectra, summarize, tables


def test_summary_edges(spark):
    df = spark.createDataFrame([("a", "x", 1.0, None), ("a", "x", 3.0, None), ("b", "x", None, None), ("b", "y", 2.0, None), (None, "y", 4.0, None), ("a", "x", 99.0, "bad")], "g string, channel string, v double, error string")
    out = {(r["g"], r["channel"]): r for r in summarize.summarize(df, ["g"], ["v"]).collect()}
    assert set(out) == {("a", "x"), ("b", "y"), (None, "y")}
    assert out[("a", "x")]["mean"] == 2.0 and out[("b", "y")]["sd"] is None and out[("b", "y")]["cv_percent"] is None
    assert summarize.summarize(df.limit(0), ["g"], ["v"]).count() == 0
    with pytest.raises(UsageError):
        summarize.summarize(df, ["g"], ["v"], test="welch")


def test_mann_whitney_with_ties_and_exact(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 2.0), ("c", 3.0), ("t", 4.0), ("t", 5.0), ("t", 6.0), ("u", 2.0), ("u", 2.0)], "g string, v double")
    out = {r["g"]: r for r in summarize.summarize(df, ["g"], ["v"], control="c", test="mann-whitney", exact_by=True).collect()}
    assert out["t"]["statistic"] == 9.0 and abs(out["t"]["p_value"] - 0.1) < 1e-12
    assert out["u"]["statistic"] == 3.0 and out["c"]["statistic"] is None


def test_sheet_join_chooses_keys_and_reports(spark):
    rows = spark.createDataFrame([("d/A.fcs", "s1", 1), ("d/B.fcs", "s2", 2), ("d/C.fcs", None, 3)], "path string, sample_id string, n int")
    sheet = spark.createDataFrame([("S1", "ctrl", 5), ("s2", "drug", 6), ("s2", "other", 7), ("s9", "none", 8)], "id string, condition string, n int")
    out, rep = joins.sheet_join(rows, sheet)
    got = {r["path"]: (r["condition"], r["n"], r["n_sheet"]) for r in out.collect()}
    assert rep.keys == [("id", "sample_id")] and rep.matched == 1 and rep.ambiguous == 1
    assert got == {"d/A.fcs": ("ctrl", 1, 5), "d/B.fcs": (None, 2, None), "d/C.fcs": (None, 3, None)}
    assert [r["id"] for r in rep.unmatched_sheet.collect()] == ["s9"]
    out, _ = joins.sheet_join(rows, spark.createDataFrame([("*.fcs", "x")], "file string, tag string"), [("file", "file")])
    assert {r["tag"] for r in out.collect()} == {"x"}


def test_plate_grid_and_layouts(spark):
    grid = spark.createDataFrame([("A", "ctrl", "drug"), ("B", None, "x")], "treatment string, `1` string, `2` string")
    assert sorted(map(tuple, joins.grid_to_wells(grid, "treatment").collect())) == [("A01", "ctrl"), ("A02", "drug"), ("B02", "x")]
    reads = spark.createDataFrame([("a1", 1.0), ("B2", 2.0)], "well string, value double")
    one = spark.createDataFrame([("A1", "blank", 1.0), ("B2", "sample", None)], "well string, role string, concentration double")
    two = spark.createDataFrame([("B02", "control")], "well string, role string")
    assert sorted((r["well"], r["role"]) for r in joins.layout_join(reads, one, two).collect()) == [("A01", "blank"), ("B02", "control")]


def test_links_and_groups(spark):
    df = spark.createDataFrame([("p/a1.czi", "XYZ123", "f1"), ("p/x.tif", "XYZ123", "f2"), ("q/x.czi", None, "f2"), ("q/ctrl.tif", "ctrl", "f3"), ("q/k.tif", "CTRL", "f4")], "path string, sample_id string, fingerprint string")
    e = link.link(df)
    g = {r["id"]: (r["component"], r["confidence"]) for r in link.groups(e).collect()}
    assert {g[x][0] for x in ("p/a1.czi", "p/x.tif", "q/x.czi")} == {"p/a1.czi"} and "q/k.tif" not in g
    assert g["p/a1.czi"][1] == link.HIGH


def test_weak_identifiers(spark):
    weak = ["QC 12", "blank", "A1", "P2-D1", "Sample_03", "run-12", "Untitled"]
    strong = ["XYZ123", "patient77x", "run-12345", "donor"]
    got = spark.createDataFrame([(x,) for x in weak + strong], "v string").select("v", link.weak_identifier(F.col("v")).alias("w")).collect()
    assert [r["v"] for r in got if r["w"]] == weak


def test_health(spark):
    df = spark.createDataFrame([("d/a.raw", "vendor"), ("d/a.tif", "open"), ("d/b.raw", None)], "path string, preservation string")
    assert [r["path"] for r in health.at_risk(df).collect()] == ["d/b.raw"]
    t = spark.createDataFrame([("mail a.b@c-d.org now",), ("call +44 20 7946 0958 ok",), ("v1.2.3 2024-01-02",), (None,)], "t string")
    assert {r["kind"]: r["rows"] for r in health.pii_tally(t, "t").collect()} == {"email": 1, "phone": 1}
    import hashlib
    import hmac

    want = "redacted:" + hmac.new(b"key", b"x", hashlib.sha256).hexdigest()[:16]
    assert t.select(health.redact(F.lit("x"), b"key")).first()[0] == want


def test_fits():
    x = np.array([0, 0.5, 1, 2, 4, 8, 16, 32.0])
    y = assay.curve("4pl", np.array([1.0, 1.5, 4.0, 10.0]), x)
    got = assay.fit_curve("4pl", x, y)
    assert np.allclose(got["p"], [1.0, 1.5, 4.0, 10.0], rtol=1e-4) and got["r2"] > 0.999999
    assert assay.fit_curve("5pl", x[:4], y[:4]) is None
    y5 = assay.curve("5pl", np.array([0.02, 1.4, 180.0, 3.2, 0.6]), x * 40)
    assert assay.fit_curve("5pl", x * 40, y5)["r2"] > 0.9999


def test_growth_and_kinetics(spark):
    t = np.arange(0, 24, 0.25)
    y = 1.2 / (1 + (1.2 / 0.01 - 1) * np.exp(-0.8 * t))
    df = spark.createDataFrame([("w", float(a), float(b)) for a, b in zip(t, y, strict=True)], "well string, t double, y double")
    g = assay.growth(df, ["well"], "t", "y").first()
    assert abs(g["r"] - 0.8) < 1e-3 and abs(g["k"] - 1.2) < 1e-3 and 0.6 < g["mu_max"] < 0.82
    k = assay.kinetics(df, ["well"], "t", "y").first()
    assert k["vmax"] > 0.2 and k["lag"] > 0
    assert assay.kinetics(df.limit(1), ["well"], "t", "y").first()["vmax"] is None


def test_growth_needs_points_over_the_threshold(spark):
    t = np.arange(100.0)
    v = np.where(t < 92, 1e-3, np.exp(t - 100))  # eight points rise, the window takes ten
    got = assay.growth_of(t, v)
    assert "mu_max" not in got and got["k"] > 0
    assert "mu_max" not in assay.growth_of(t, np.linspace(2, 1, 100))
    assert assay.growth_of(t, -v) == {} and assay.growth_of(t[:1], v[:1]) == {}
    df = spark.createDataFrame([("w", None, 1.0), ("w", 1.0, None)], "well string, t double, y double")
    assert tuple(assay.growth(df, ["well"], "t", "y").first()) == ("w", None, None, None, None, None, None)


def test_standard_errors_against_closed_forms():
    rng = np.random.default_rng(3)
    x = np.repeat([1.0, 2, 4, 8, 16], 3)
    y = 2 + 3 * x + rng.normal(0, 0.5, len(x))
    got = assay.fit_curve("linear", x, y)
    s2 = got["sse"] / (len(x) - 2)
    want = np.sqrt(np.diag(s2 * np.linalg.inv(np.stack([np.ones_like(x), x]) @ np.stack([np.ones_like(x), x]).T)))
    assert np.allclose(got["se"], want, rtol=1e-6) and got["df"] == 13 and got["levels"] == 5
    assert assay.fit_curve("linear", x[[0, 3]], y[[0, 3]])["se"] is None


def test_native_lines_equal_the_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(a), float(1 + a + rng.normal())) for k in ("p", "q") for a in range(6)] + [("p", None, 1.0), ("q", float("inf"), 1.0), ("r", 1.0, 1.0), ("r", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in assay.fit(df, ["k"], "x", "y", "linear").collect()}
    assert got["r"]["a"] is None and got["r"]["levels"] is None
    weighted = {r["k"]: r for r in assay.fit(df.where("y > 0").withColumn("y", F.col("y") + 10), ["k"], "x", "y", "linear", "1/y").collect()}
    assert weighted["r"]["a"] is None and weighted["p"]["se_b"] > 0
    for k in ("p", "q"):
        x, y = (np.array([r[i] for r in rows if r[0] == k and r[1] is not None and np.isfinite(r[1])]) for i in (1, 2))
        want = assay.fit_curve("linear", x, y)
        assert np.allclose([got[k][c] for c in ("a", "b", "se_a", "se_b", "r2", "sse", "residual_se", "df", "n")], [*want["p"], *want["se"], *(want[c] for c in ("r2", "sse", "residual_se", "df", "n"))], rtol=1e-9)


def test_back_calculation_and_limits(spark):
    x = np.array([1000.0 / 2**i for i in range(7)])
    p = np.array([0.02, 1.4, 180.0, 3.2])
    y = assay.curve("4pl", p, x)
    noise = np.where(x == x.min(), 0.5, 0.01)  # the lowest level repeats badly
    std = spark.createDataFrame([("e", float(a), float(b * (1 + s * n))) for a, b, n in zip(x, y, noise, strict=True) for s in (-1, 1)], "plate string, nominal double, y double")
    fits = assay.fit(std, ["plate"], "nominal", "y", "4pl")
    wells = spark.createDataFrame([("e", "in", float(assay.curve("4pl", p, np.array([100.0]))[0]), 10.0), ("e", "low", 0.001, 1.0), ("e", "high", 9.0, 1.0), ("e", "none", None, 1.0), ("f", "lost", 1.0, None), ("e", "above", float(assay.curve("4pl", p, np.array([1500.0]))[0]), None)], "plate string, w string, y double, dil double")
    got = {r["w"]: r for r in assay.back_calculate(wells, fits, ["plate"], "y", "4pl", dilution="dil").collect()}
    assert {k: r["flag"] for k, r in got.items()} == {"in": "in_range", "low": "below_curve", "high": "above_curve", "none": None, "lost": "not_computable", "above": "above_range"}
    assert abs(got["in"]["final_concentration"] - 1000) < 50 and got["high"]["back_calculated"] is None
    r = assay.quantification_limits(std, fits, ["plate"], "nominal", "y").first()
    assert r["lloq"] == x[-2] and r["uloq"] == x[0]


def test_many_growths_at_once(spark):
    """Wells of many lengths together give what each gives alone, in rows of all partitions."""
    r = np.random.default_rng(5)
    wells = []
    for i in range(40):
        t = np.arange(int(r.integers(1, 60)), dtype=float)
        wells.append((t, 10 / (1 + 99 * np.exp(-0.4 * t)) + r.normal(0, 1e-3, len(t)) if i % 9 else -t))
    together = assay.growths(wells)
    for w, g in zip(wells, together, strict=True):
        alone = assay.growth_of(*w)
        assert g.keys() == alone.keys() and all(np.isclose(g[c], alone[c], rtol=1e-5) for c in g)
    rows = [(k, float(a), float(b)) for k, (t, v) in enumerate(wells) for a, b in zip(t, v, strict=True)] + [(77, None, 1.0), (1, float("nan"), 3.0), (1, 5.0, None)]
    out = assay.growth(spark.createDataFrame(rows, "well int, t double, y double"), ["well"], "t", "y")
    got = {d["well"]: d for d in out.collect()}
    assert len(got) == 41 and got[77]["well"] == 77 and got[77][4] is None
    for k, g in enumerate(together):
        assert all((got[k][1 + i] is None) == (c not in g) and (c not in g or np.isclose(got[k][1 + i], g[c], rtol=1e-5)) for i, c in enumerate(("mu_max", "doubling", "lag", "k", "r", "n0")))
    assert out.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_range_parses_its_wells_once(spark):
    """Each pattern stands in the plan once for an end, not once for each use of what it finds."""
    d = spark.createDataFrame([("A1:B2",), (" h12:R2C3",), ("af48",), ("A1:B2:C3",), ("R33C1:A1",), ("A0",), ("A1\n:B1",), ("AA1:Z2",)], "t string").select(S.well_range(F.col("t")).alias("w"), S.well(F.col("t")).alias("one"))
    got = [tuple(r) for r in d.collect()]
    assert got[0] == (["A01", "A02", "B01", "B02"], None) and got[1][0][0] == "B03" and len(got[1][0]) == 70 and got[2] == (["AF48"], "AF48")
    assert [r[0] for r in got[3:6]] == [None, None, None] and got[6][0] == ["A01", "B01"] and got[7][0] == ["Z01", "Z02", "AA01", "AA02"]
    assert d._jdf.queryExecution().analyzed().toString().count("regexp_extract(") <= 12


def test_many_curves_at_once(spark):
    """Series of many lengths are fitted together, each as if alone, and dealt over all partitions."""
    r = np.random.default_rng(3)
    series = []
    for i in range(60):
        x = np.sort(r.choice(np.arange(1, 60), int(r.integers(5, 30)), replace=False)).astype(float)
        y = assay.curve("4pl", np.array([1.0, 1.5, 20.0, 9.0 + i]), x) + r.normal(0, 0.01, len(x))
        y[0] = np.nan if i % 7 == 0 else y[0]
        series.append((x, y) if i % 10 else (x[:3], y[:3]))
    for model in ("4pl", "5pl"):
        got = assay.fit_curves(model, series)
        for i, (s, g) in enumerate(zip(series, got, strict=True)):
            alone = assay.fit_curve(model, *s)
            assert (g is None) == (alone is None) and (g is not None or i % 10 == 0 or len(s[0]) < 7)
            if g:
                assert np.isclose(g["sse"], alone["sse"], rtol=1e-6) and g["n"] == alone["n"] and (model == "5pl" or np.allclose(g["p"], alone["p"], rtol=1e-4))
    rows = [(k, float(x), float(y)) for k, (u, v) in enumerate(series) for x, y in zip(u, v, strict=True)]
    rows += [(None, float(x), float(y)) for x, y in zip(*series[1], strict=True)] + [(99, 1.0, None), (99, float("inf"), 2.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    out = assay.dose_response(df, ["k"], "x", "y")
    got = {d["k"]: d for d in out.collect()}
    assert len(got) == 62 and got[99]["error"] and got[None]["ec50"] == got[1]["ec50"] and np.isclose(got[1]["ec50"], 20, rtol=0.05)
    # little data, but much work: not left to one task
    assert out.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dose_response_recovers_what_was_planted(spark):
    rng = np.random.default_rng(20260923)
    doses = [10.0 / 3**i for i in range(10)]
    planted = {"A": (0.25, 1.0, 2000.0, 3), "B": (1.8, 1.5, 2000.0, 3), "C": (3.0, 0.8, 20000.0, 2)}
    rows = [(k, d, float((low + (1e5 - low) / (1 + (d / ic) ** h)) * (1 + 0.01 * rng.normal()))) for k, (ic, h, low, m) in planted.items() for _ in range(m) for d in doses]
    rows += [("up", d, float(5 + 90 * d / (d + 0.5))) for d in doses] + [("few", 1.0, 2.0), ("few", 2.0, 2.5), ("flat", None, 1.0)]
    df = spark.createDataFrame(rows, "compound string, dose double, y double")
    got = {r["compound"]: r for r in assay.dose_response(df, ["compound"], "dose", "y").collect()}
    for k, (ic, h, *_) in planted.items():
        r = got[k]
        assert r["kind"] == "IC50" and abs(r["ec50"] / ic - 1) < 0.15 and abs(-r["hill_slope"] / h - 1) < 0.15
        assert r["ec50_ci_low"] < r["ec50"] < r["ec50_ci_high"] and not r["extrapolated"]
    assert got["few"]["error"] and got["few"]["ec50"] is None and "flat" not in got
    up = assay.effect_of(*(np.array([r[i] for r in rows if r[0] == "up"]) for i in (1, 2)), "4pl", normalized=True)
    assert up["kind"] == "EC50" and abs(up["ec50"] - 0.5) < 1e-3 and abs(up["absolute_ec50"] - 0.5) < 1e-3
    x = np.array(doses)
    y5 = assay.curve("5pl", np.array([1.0, 1.2, 0.8, 9.0, 0.7]), x)
    five = assay.effect_of(x, y5, "5pl")
    assert abs(np.interp(five["ec50"], x[::-1], y5[::-1]) - 5.0) < 0.3


def test_grubbs(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 0.9, 1.05, 0.95, 9.0)], "g string, v double")
    assert [r["v"] for r in assay.outliers(df, ["g"], "v").where("outlier").collect()] == [9.0]


def test_cq_on_a_sigmoid(spark):
    c = np.arange(1, 41)
    y = 0.05 + 0.001 * c + 5 / (1 + np.exp(-(c - 25) / 1.6))
    df = spark.createDataFrame([("w", int(a), float(b)) for a, b in zip(c, y, strict=True)], "well string, cycle int, fluorescence double")
    r = qpcr.threshold_cq(df, ["well"], threshold=0.5).first()
    assert 20 < r["cq"] < 22.5
    flat = df.withColumn("fluorescence", F.lit(1.0))
    assert qpcr.threshold_cq(flat, ["well"]).first()["cq"] is None


def test_pfaffl(spark):
    df = spark.createDataFrame([("c", "r", 20.0, 2.0), ("c", "t", 25.0, 2.0), ("s", "r", 20.0, 2.0), ("s", "t", 23.0, 2.0)], "sample string, target string, cq double, efficiency double")
    out = {r["sample"]: r["ratio"] for r in qpcr.pfaffl(df, ["r"], "c").collect()}
    assert abs(out["s"] - 4) < 1e-9 and abs(out["c"] - 1) < 1e-9


def test_gates_and_logicle(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (float("nan"), 1.0), (None, 2.0)], "x double, y double")
    gates = [gating.Gate("p", "polygon", ("x", "y", [(0, 0), (2, 0), (2, 2), (0, 2)])), gating.Gate("n", "complement", "p"), gating.Gate("e", "ellipsoid", (["x", "y"], [3, 3], [[1, 0], [0, 1]], 1.0)), *gating.quadrants("q", "x", "y", 2.0, 2.0)]
    out = {r["population"]: r["count"] for r in gating.populations(df, gates, []).collect()}
    assert out["p"] == 1 and out["n"] == 3 and out["e"] == 1 and out["q2"] == 1 and out["q4"] == 1
    v = gating.logicle_values(np.array([262144.0, 0.0, -100.0, 1000.0]))
    assert abs(v[0] - 1) < 1e-6 and v[2] < v[1] < v[3]
    assert df.select(gating.logicle(F.col("x"))).collect()[3][0] is None


def test_chromatographic_peaks():
    t = np.linspace(0, 10, 2000)
    y = 100 * np.exp(-((t - 3) ** 2) / (2 * 0.05**2)) + 50 * np.exp(-((t - 6) ** 2) / (2 * 0.05**2)) + np.random.default_rng(0).normal(0, 0.05, 2000)
    p = [q for q in signal.chromatographic_peaks(t, y, 11, 20)]
    assert [round(q["rt"], 1) for q in p] == [3.0, 6.0] and abs(p[0]["area"] - 100 * 0.05 * np.sqrt(2 * np.pi)) < 0.5 and p[1]["resolution"] > 10
    assert signal.chromatographic_peaks(t[:2], y[:2]) == []


def test_nmr_and_spikes():
    n, width = 4096, 4000.0
    k = np.arange(n) / width
    fid = np.exp(2j * np.pi * 500 * k - 5 * k) * np.exp(0.7j)
    ppm, s = signal.process_fid(fid.real, fid.imag, width, 400.0)
    assert abs(max(signal.nmr_peaks(ppm, s), key=lambda q: q["height"])["ppm"] - 1.25) < 0.01
    t = np.arange(0, 1, 1e-4)
    v = -65 + sum(100 * np.exp(-((t - c) ** 2) / (2 * 0.0005**2)) for c in (0.2, 0.5, 0.8))
    assert [round(q["t"], 2) for q in signal.spikes(t, v)] == [0.2, 0.5, 0.8]
    y = np.random.default_rng(1).normal(0, 1, 20000)
    tt = np.arange(20000) / 20000
    y[5000] = y[5001] = y[12000] = y[12001] = -40
    assert [round(q["t"], 2) for q in signal.extracellular(tt, y, k=6)] == [0.25, 0.6]


def test_images():
    p = np.zeros((20, 20))
    p[2:6, 2:6], p[10:15, 8:12] = 100, 120
    got = signal.objects(p)
    assert [o["area"] for o in got] == [16, 20] and signal.sharpness(p) > 0
    assert signal.line_profile(p, (3, 0), (3, 10))[3] == 100


def test_isotopes_and_southern():
    mz = np.array([500.0 + k * 1.00335 / 2 for k in range(4)] + [700.0])
    got = spectra.isotope_charges(mz, np.array([100, 60, 30, 10, 50.0]), 5, 8)
    assert [(round(g["mz"]), g["charge"]) for g in got] == [(500, 2), (700, 0)]
    # a lower isotope moves the start of the pattern, a small point beside an isotope doesn't hide it
    mz = np.array([499.498, 500.0, 500.499, 500.502, 501.003, 501.505])
    got = spectra.isotope_charges(mz, np.array([40.0, 100, 0.5, 60, 30, 10]), 3, 8)
    assert got[0]["charge"] == 2 and got[0]["isotopes"] == 3 and abs(got[0]["monoisotopic_mz"] - 499.49832) < 1e-4
    assert abs(got[0]["neutral_mass"] - 2 * (499.4983225 - 1.007276)) < 1e-6
    assert [round(g["mz"], 3) for g in got] == [500.0]
    assert spectra.isotope_charges(np.zeros(0), np.zeros(0), 3, 8) == []
    bp = np.array([100, 200, 300, 400, 500.0])
    tt = 1000 + bp * 3
    assert abs(signal.local_southern(1000 + 250 * 3, tt, bp) - 250) < 1.0


def test_series_edges(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(9)] + [("b", 0, 1.0)], "k string, i int, y double")
    assert series.sliding_slope(df, ["k"], ["i"], "i", "y", 3).count() == 1
    assert series.derivative(df, ["k"], ["i"], "i", "y", True).where("derivative is not null").count() == 7
    assert abs(sum(series.savitzky_golay_weights(7)) - 1) < 1e-12


def test_curve_fits_take_every_row(spark):
    from oracle import DATA, connection

    from fathomry.plans.queries import QUERIES

    sql = "SELECT l_suppkey, regr_intercept(l_quantity, l_linenumber), regr_slope(l_quantity, l_linenumber), regr_r2(l_quantity, l_linenumber), count(*) - 2 FROM lineitem GROUP BY l_suppkey ORDER BY 1"
    want = connection("sf0.001").execute(sql).fetchall()
    got = sorted(map(tuple, QUERIES["curve_fits"](spark, str(DATA / "sf0.001")).select("l_suppkey", "a", "b", "r2", "df").collect()))
    assert [(x[0], x[4]) for x in got] == [(x[0], x[4]) for x in want]
    assert np.allclose([x[1:4] for x in got], [x[1:4] for x in want])


def test_lines_by_sums_equal_the_fit_of_points(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.5), ("a", 3.0, 5.0), ("a", nan, 1.0), ("a", 9.0, inf), ("a", 8.0, None), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("b", None, 9.0), ("c", 1.0, 7.0), ("c", 2.0, 7.0), (None, 1.0, 1.0)]
    got = {r["k"]: r for r in assay.fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", "linear").collect()}
    assert set(got) == {"a", "b", "c", None}
    for k, r in got.items():
        x, y = (np.array([np.nan if v[i] is None else v[i] for v in rows if v[0] == k]) for i in (1, 2))
        f = assay.fit_curve("linear", x, y)
        if f is None:
            assert all(r[c] is None for c in ("a", "b", "r2", "df"))
        else:
            assert np.allclose([r["a"], r["b"], r["r2"]], [*f["p"], f["r2"]]) and r["df"] == f["df"]
        assert r["c"] is None and r["d"] is None and r["g"] is None


def test_positions_of_a_whole_table(spark):
    from oracle import compare

    from fathomry.plans.queries import ORACLE, QUERIES

    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 37) % 5000 v")
    out = tables.positions(df, [F.col("v").desc()])
    assert sorted(map(tuple, out.collect())) == [(v, 5000 - v) for v in range(5000)]
    assert tables.positions(df.limit(0), [F.col("v")]).count() == 0
    assert compare(spark, "natural_sort", QUERIES["natural_sort"], ORACLE["natural_sort"], "sf0.01") is None


def test_components_of_a_whole_table(spark):
    from oracle import DATA, connection

    from fathomry.plans.queries import QUERIES

    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in connection("sf0.001").execute("SELECT DISTINCT l_partkey, -l_suppkey FROM lineitem").fetchall():
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = sorted(map(tuple, QUERIES["link_components"](spark, str(DATA / "sf0.001")).collect()))
    assert got == sorted((x, root(x)) for x in list(up))


def test_components_send_no_labels_over_the_driver(spark):
    """Joins of nodes' labels are shuffled, though their files are small; loops, repeats, null ends and paths count as before."""
    from fathomry.operators.graph import connected_components

    rows = [(f"n{(i * 7) % 50:02d}", f"n{(i * 7 + 7) % 50:02d}") for i in range(30)] * 2 + [("x", "x"), ("y", "x2"), ("x2", "x2"), ("z", None), (None, "z"), (None, None), ("n00", "n00"), ("w", "a0"), ("w", "w")]
    up: dict[str, str] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in rows:
        if a and b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = sorted(map(tuple, connected_components(spark.createDataFrame(rows, "a string, b string")).collect()))
    assert got == sorted((x, root(x)) for x in list(up)) and len({c for _, c in got}) > 3
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    plans = [e.physicalPlanDescription() for e in (store.executionsList().apply(i) for i in range(before, store.executionsCount()))]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
    assert connected_components(spark.createDataFrame([("x", "x")] * 2, "a string, b string").union(spark.createDataFrame([("z", None)], "a string, b string"))).collect() == [("x", "x")]
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_times_over_midnight_and_whole_hours_apart_are_linked(spark):
    df = spark.createDataFrame([("a", 86_399.5, 1), ("b", 86_400.3, 1), ("c", 86_400.2 + 7200, 1), ("d", 90_000.0 + 900, 1), ("e", 86_399.5, 2)], "path string, started_at double, instrument_serial int")
    got = {(r["a"], r["b"]) for r in link.same_time(df, "path", "started_at", 1.0, ["instrument_serial"]).collect()}
    assert got == {("a", "c"), ("b", "c")}  # neighbours by the time within the hour: a chain
    assert {(r["a"], r["b"]) for r in link.same_time(df.where("path <> 'c'"), "path", "started_at", 1.0, ["instrument_serial"]).collect()} == {("a", "b")}
    assert link.link(df).where("kind = 'same_acquisition'").count() == len(got)


def test_grubbs_limits_for_any_number_of_sizes(spark):
    rows = [(n, float(i % 2)) for n in range(3, 90) for i in range(n - 1)] + [(n, 50.0) for n in range(3, 90)]
    got = assay.outliers(spark.createDataFrame(rows, "g int, v double"), ["g"], "v")
    assert got.columns == ["g", "v", "outlier"] and {(r["g"], r["v"]) for r in got.where("outlier").collect()} >= {(n, 50.0) for n in range(5, 90)}


def test_more_globs_than_one_pass_takes(spark, monkeypatch):
    monkeypatch.setattr(joins, "GLOBS", 3)
    rows = spark.createDataFrame([(f"run{i:02d}x",) for i in range(10)] * 2, "sample_name string")
    sheet = spark.createDataFrame([(f"run{i:02d}*", i) for i in range(10)], "name string, n int")
    out, report = joins.sheet_join(rows, sheet, [("name", "sample_name")])
    assert sorted((r["sample_name"], r["n"]) for r in out.collect()) == sorted([(f"run{i:02d}x", i) for i in range(10)] * 2) and report.matched == 20


def test_a_crossing_at_the_last_cycle_counts():
    cycle = np.arange(1.0, 21.0)
    y = np.where(cycle < 20, 1 + 0.001 * (cycle % 3), 5.0)
    cq, threshold = qpcr.cq_of(cycle, y, 1.0)
    assert 19 <= cq <= 20 and threshold == 1.0


def test_roles_dilutions_and_ranges(spark):
    def of(rows, f):
        return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "v string").select(f(F.col("v"))).collect()]

    assert of(["STD3", "Blank1", "SPL2:1", "Un0004", "Standard S1", "Negative control N", "CTL1", "s4", "s", "-", "", None, "no cells", "pc2", "posx"], layout.role_of_name) == ["standard", "blank", "sample", "sample", "standard", "negative", "control", "standard", "sample", "empty", "empty", "empty", "blank", "positive", "sample"]
    assert of(["BLK", "NC", "+", "-", "Std. Curve", "n/a", "dose", "other", None, ""], layout.role) == ["blank", "negative", "positive", "negative", "standard", "empty", "sample", None, None, "empty"]
    assert of(["1:10", "1/10", "10x", "10", "0.5", "0", "a", "1:0", "", None, "2:5"], S.dilution) == [10.0, 10.0, 10.0, 10.0, 2.0, None, None, None, None, None, 2.5]
    assert of(["1 microg/ml", "-2.5e3pg", "5eq", "1.5.2", "x", None, "7"], lambda c: S.leading_number(c)[0]) == [1.0, -2500.0, None, None, None, None, 7.0]
    assert of(["1 microg/ml", "7", "x"], lambda c: S.leading_number(c)[1]) == ["microg/ml", "", None]
    assert of(["A1:B2", "B2:A1", "Z1:AA1", "C3", "A1:x", "", None], S.well_range) == [["A01", "A02", "B01", "B02"]] * 2 + [["Z01", "AA01"], ["C03"], None, None, None]
    assert of(["x"], lambda c: S.plate_size(F.lit(9), F.lit(2))) == [384] and of(["x"], lambda c: S.plate_size(F.lit(33), F.lit(2))) == [None]


def test_licences_and_integrity(spark):
    rows = [("CC0 1.0 Universal",), ("cc by 4.0 NonCommercial: attribution-noncommercial 4.0",), ("neither the name of the copyright holder",), ("all rights reserved",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(catalog.licence(F.col("t"))).collect()] == ["CC0-1.0", "CC-BY-NC-4.0", "BSD-3-Clause", None, None]
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    found = spark.createDataFrame([("a", "warning"), ("b", "Error"), ("b", "info"), ("z", "error")], "path string, severity string")
    assert sorted(map(tuple, catalog.integrity(items, found, "path").collect())) == [("a", True, 0, 1, 0), ("b", False, 1, 0, 1), ("c", True, 0, 0, 0)]


def test_plane_selection(spark):
    df = spark.createDataFrame([(c, z, 0) for c in range(3) for z in range(6)], "c int, z int, t int")
    assert tables.planes(df, "c=0,1,z=2-4").count() == 6 and tables.planes(df).count() == 18 and tables.planes(df, "Z=5", "z = 0 - 1").count() == 9
    for bad in ("x=1", "z=3-1", "z=", "c"):
        with pytest.raises(UsageError):
            tables.planes(df, bad)


def test_merged_statistics_and_pearson(spark):
    rng = np.random.default_rng(7)
    fields = [rng.normal(50, 4 + k, 30 + 10 * k) for k in range(3)]
    parts = spark.createDataFrame([("A01", len(v), float(v.mean()), float(v.std()), float(v.min()), float(v.max())) for v in fields], "well string, count long, mean double, std double, min double, max double")
    r, v = series.merged_statistics(parts, ["well"]).first(), np.concatenate(fields)
    assert np.allclose([r["count"], r["mean"], r["std"], r["min"], r["max"]], [len(v), v.mean(), v.std(), v.min(), v.max()])
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, None), ("c", 1.0, 1.0)], "k string, x double, y double")
    assert {r["k"]: r["r"] for r in series.pearson(flat, ["k"], "x", "y").collect()} == {"a": None, "c": None}


def test_hyperlog_and_sample_matches(spark):
    t, w, m, a = 1000.0, 1.0, 4.0, 0.0
    v = gating.hyperlog_values(np.array([t, 0.0, 10.0, -10.0]), t, w, m, a)
    assert abs(v[0] - 1) < 1e-9 and abs(v[1] - 0.25) < 1e-9 and abs(v[2] + v[3] - 0.5) > 0 and v[3] < v[1] < v[2] < v[0]
    samples = spark.createDataFrame([("1", "a.fcs", None, "x"), ("2", "b.fcs", "a2.fcs", "x"), ("3", "b.fcs", None, "y")], "sample string, name string, uri_name string, fil string")
    files = spark.createDataFrame([("a.fcs", None), ("a2.fcs", "y"), ("b.fcs", " y "), ("b.fcs", "x"), ("c.fcs", None)], "file string, fil string")
    assert sorted((r["file"], r["sample"] or "") for r in gating.match_samples(files, samples).collect()) == [("a.fcs", "1"), ("a2.fcs", "2"), ("b.fcs", ""), ("b.fcs", "3"), ("c.fcs", "")]
    assert [r["sample"] for r in gating.match_samples(files.where("file = 'c.fcs'"), samples.where("sample = '1'")).collect()] == ["1"]


def test_pulse_response_recovers_the_circuit():
    access, membrane, c, step = 10.0, 200.0, 30.0, 10.0  # MOhm, MOhm, pF, mV
    t = np.arange(0, 0.06, 2e-5)
    tau = access * membrane / (access + membrane) * c * 1e-6
    steady = step / (access + membrane) * 1000
    i = np.where((t >= 0.01) & (t < 0.05), steady + (step / access * 1000 - steady) * np.exp(-(t - 0.01) / tau), 0.0)
    got = signal.pulse_response(t, i, 0.01, 0.05, step)
    assert np.allclose([got["access"], got["membrane"], got["tau"], got["capacitance"]], [access, membrane, tau * 1000, c], rtol=0.02)
    down = signal.pulse_response(t, -i, 0.01, 0.05, -step)
    assert np.allclose(list(down.values()), list(got.values()))
    assert signal.pulse_response(t, np.zeros_like(t), 0.01, 0.05, step)["access"] is None


def test_default_values_of_measures(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, "x")], "mean double, other double, t int, name string")
    assert summarize.primary_values("stats", df) == ["mean"] and summarize.primary_values("qpcr", df) == ["mean", "other"]
