"""Signal analyses per trace in numpy: chromatographic peaks, NMR, electrophysiology, images.

Each is a function over arrays and a DataFrame operator that groups by trace; a trace is
one acquisition, the unit that fits a task by nature.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .series import savitzky_golay_weights


def per_trace(df: DataFrame, keys: list[str], columns: list[str], f: Callable[..., list[dict]], schema: str) -> DataFrame:
    """Rows that f makes of a trace's columns (sorted by the first one)."""
    names = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    out_names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna().sort_values(columns[0])
        rows = f(*(p[c].to_numpy(float) for c in columns))
        return pd.DataFrame([[*key, *(r.get(n) for n in out_names)] for r in rows], columns=[*keys, *out_names])

    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(run, ", ".join([*names, schema]))


# Chromatography


def smooth(y: np.ndarray, window: int) -> np.ndarray:
    if window < 3 or len(y) < window:
        return y.astype(float)
    out = np.convolve(y, savitzky_golay_weights(window)[::-1], "same")
    h = window // 2
    out[:h], out[-h:] = y[:h], y[-h:]
    return out


def noise_level(y: np.ndarray) -> float:
    """A low quartile of detrended segments' RMS; short signals by the MAD of differences."""
    n = len(y)
    size = int(min(max(n // 100, 16), 2000))
    rms = []
    for a in range(0, n - size + 1, size):
        s = y[a : a + size]
        t = np.arange(size)
        r = s - np.polyval(np.polyfit(t, s, 1), t)
        rms.append(float(np.sqrt((r * r).sum() / (size - 2))))
    flat = [v for v in rms if v == 0]
    if rms and len(flat) > len(rms) / 4:
        rms = [v for v in rms if v > 0]
    if len(rms) >= 4:
        return sorted(rms)[round((len(rms) - 1) * 0.25)]
    d = np.diff(y)
    return float(1.4826 * np.median(np.abs(d - np.median(d))) / np.sqrt(2)) if len(d) else 0.0


PEAKS = "rt double, start double, end double, height double, area double, area_percent double, width_half double, tailing double, plates double, resolution double, signal_to_noise double"


def chromatographic_peaks(t: np.ndarray, y: np.ndarray, window: int = 5, least_sn: float = 3.0) -> list[dict]:
    """Peaks between valleys over a straight baseline, with the usual figures of merit."""
    if len(y) < 5:
        return []
    s, noise = smooth(y, window), noise_level(y)
    top = np.flatnonzero((s[1:-1] > s[:-2]) & (s[1:-1] >= s[2:])) + 1
    out: list[dict] = []
    base = np.quantile(s, 0.25)
    for i in top:
        a = i
        while a > 0 and s[a - 1] < s[a]:
            a -= 1
        b = i
        while b < len(s) - 1 and s[b + 1] < s[b]:
            b += 1
        line = s[a] + (s[b] - s[a]) * (t[a : b + 1] - t[a]) / (t[b] - t[a]) if t[b] > t[a] else np.full(b - a + 1, s[a])
        v = y[a : b + 1] - line
        h = float(v[i - a])
        if b - a < 3 or h <= 0 or h < least_sn * max(noise, 1e-12 * max(abs(base), 1.0)):
            continue
        area = float(((t[a + 1 : b + 1] - t[a:b]) * (v[1:] + v[:-1]) / 2).sum())

        def at(level: float, v=v, a=a, i=i) -> tuple[float, float]:
            k = i - a
            lo = k
            while lo > 0 and v[lo] > level * v[k]:
                lo -= 1
            hi = k
            while hi < len(v) - 1 and v[hi] > level * v[k]:
                hi += 1
            f = lambda p, q: t[a + p] + (t[a + q] - t[a + p]) * (level * v[k] - v[p]) / (v[q] - v[p]) if v[q] != v[p] else t[a + p]
            return float(f(lo, min(lo + 1, len(v) - 1))), float(f(hi, max(hi - 1, 0)))

        (l5, r5), (l05, r05) = at(0.5), at(0.05)
        w = r5 - l5
        out.append({"rt": float(t[i]), "start": float(t[a]), "end": float(t[b]), "height": h, "area": area, "width_half": w, "tailing": (r05 - l05) / (2 * (t[i] - l05)) if t[i] > l05 else None, "plates": 5.54 * (t[i] / w) ** 2 if w > 0 else None, "signal_to_noise": h / noise if noise > 0 else None})
    total = sum(p["area"] for p in out)
    for k, p in enumerate(out):
        p["area_percent"] = 100 * p["area"] / total if total > 0 else None
        if k:
            w = p["width_half"] + out[k - 1]["width_half"]
            p["resolution"] = 1.18 * (p["rt"] - out[k - 1]["rt"]) / w if w > 0 else None
    return out


def peaks(df: DataFrame, keys: list[str], t: str, y: str, window: int = 5, least_sn: float = 3.0) -> DataFrame:
    return per_trace(df, keys, [t, y], lambda a, b: chromatographic_peaks(a, b, window, least_sn), PEAKS)


# NMR


def process_fid(re: np.ndarray, im: np.ndarray, width_hz: float, reference_mhz: float, carrier_ppm: float = 0.0, broadening_hz: float = 0.3, phase: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ppm, real spectrum): zero filling to twice the next power of two, exponential window, FFT, phase, baseline."""
    n = len(re)
    size = 2 * (1 << max(n - 1, 1).bit_length())
    fid = (re + 1j * im) * np.exp(-np.pi * broadening_hz * np.arange(n) / width_hz)
    fid[0] /= 2
    spec = np.fft.fftshift(np.fft.fft(fid, size))
    ppm = carrier_ppm + np.fft.fftshift(np.fft.fftfreq(size, 1 / width_hz)) / reference_mhz
    p0, p1 = phase if phase is not None else auto_phase(spec)
    real = (spec * np.exp(1j * (p0 + p1 * np.linspace(-0.5, 0.5, size)))).real
    return ppm, real - np.median(real)


def _roughness(spec: np.ndarray, p0: float, p1: float) -> float:
    r = (spec * np.exp(1j * (p0 + p1 * np.linspace(-0.5, 0.5, len(spec))))).real
    d = np.abs(np.diff(r))
    d = d / max(d.sum(), 1e-300)
    entropy = -(d[d > 0] * np.log(d[d > 0])).sum()
    return entropy + 1e3 * (np.minimum(r, 0) ** 2).sum() / max((r * r).sum(), 1e-300)


def auto_phase(spec: np.ndarray) -> tuple[float, float]:
    """A coarse grid, then shrinking steps, on entropy of the derivative and negative area."""
    s = spec[:: max(1, len(spec) // 8192)]
    best = min(((_roughness(s, a, b), a, b) for a in np.linspace(-np.pi, np.pi, 24, endpoint=False) for b in (-1.0, 0.0, 1.0)))
    step = 0.2
    while step > 1e-3:
        new = min((_roughness(s, best[1] + i * step, best[2] + j * step), best[1] + i * step, best[2] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1))
        step = step if new[0] < best[0] - 1e-12 else step / 2
        best = min(best, new)
    return best[1], best[2]


def nmr_peaks(ppm: np.ndarray, y: np.ndarray, least_sn: float = 10.0) -> list[dict]:
    """Local maxima over the noise, apex by a parabola."""
    noise = 1.4826 * np.median(np.abs(y - np.median(y)))
    i = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] > least_sn * noise)) + 1
    a, b, c = y[i - 1], y[i], y[i + 1]
    d = np.where(a - 2 * b + c != 0, 0.5 * (a - c) / np.where(a - 2 * b + c != 0, a - 2 * b + c, 1), 0.0)
    return [{"ppm": float(ppm[k] + s * (ppm[1] - ppm[0])), "height": float(v - 0.25 * (x - z) * s)} for k, s, v, x, z in zip(i, d, b, a, c, strict=True)]


# Electrophysiology


def spikes(t: np.ndarray, v: np.ndarray, level: float = 0.0, rise: float = 20.0) -> list[dict]:
    """Action potentials: threshold where dV/dt reaches `rise` V/s (mV per ms), peak, amplitude, width at half height, trough."""
    up = np.flatnonzero((v[:-1] < level) & (v[1:] >= level)) + 1
    out = []
    dv = np.gradient(v, t) / 1000
    for k, i in enumerate(up):
        end = up[k + 1] if k + 1 < len(up) else len(v)
        p = i + int(np.argmax(v[i : min(end, i + max(3, int(0.005 / max(t[1] - t[0], 1e-9))))]))
        a = i
        while a > 0 and dv[a - 1] >= rise:
            a -= 1
        half = v[a] + (v[p] - v[a]) / 2
        lo, hi = p, p
        while lo > a and v[lo] > half:
            lo -= 1
        while hi < end - 1 and v[hi] > half:
            hi += 1
        out.append({"t": float(t[p]), "threshold": float(v[a]), "peak": float(v[p]), "amplitude": float(v[p] - v[a]), "half_width": float(t[hi] - t[lo]), "trough": float(v[p:end].min())})
    return out


def butterworth_bandpass(y: np.ndarray, rate: float, low: float, high: float, order: int = 5) -> np.ndarray:
    """Zero-phase response of a Butterworth band pass, applied in the frequency domain (once each way)."""
    f = np.fft.rfftfreq(len(y), 1 / rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = 1 / (1 + (f / high) ** (2 * order)) * np.where(f > 0, 1 / (1 + (low / np.where(f > 0, f, 1)) ** (2 * order)), 0.0)
    return np.fft.irfft(np.fft.rfft(y) * h, len(y))


def extracellular(t: np.ndarray, y: np.ndarray, low: float = 300.0, high: float = 6000.0, k: float = 5.0, refractory_s: float = 0.001) -> list[dict]:
    """Troughs under k deviations (by the MAD), one per refractory window."""
    if len(t) < 8:
        return []
    rate = 1 / np.median(np.diff(t))
    f = butterworth_bandpass(y, rate, low, min(high, 0.45 * rate))
    thr = k * np.median(np.abs(f)) / 0.6745
    out: list[dict] = []
    for i in np.flatnonzero(f < -thr):
        if out and t[i] - out[-1]["t"] < refractory_s:
            if f[i] < out[-1]["amplitude"]:
                out[-1] = {"t": float(t[i]), "amplitude": float(f[i])}
        else:
            out.append({"t": float(t[i]), "amplitude": float(f[i])})
    return out


def passive(t: np.ndarray, v: np.ndarray, start: float, end: float, current_pa: float) -> dict:
    """Resting level, input resistance (MOhm), time constant (s) and sag of a step."""
    base, steady = v[t < start].mean(), v[(t > start + 0.8 * (end - start)) & (t < end)].mean()
    on = (t >= start) & (t <= end)
    peak = v[on].min() if current_pa < 0 else v[on].max()
    out = {"rest": float(base), "resistance": float((steady - base) / current_pa * 1000), "sag": float((peak - steady) / (peak - base)) if peak != base else None}
    target = base + (steady - base) * (1 - np.exp(-1))
    cross = np.flatnonzero(on & ((v - target) * np.sign(steady - base) >= 0))
    return out | {"tau": float(t[cross[0]] - start) if len(cross) else None}


def pulse_response(t: np.ndarray, i: np.ndarray, start: float, end: float, step_mv: float) -> dict:
    """Access and membrane resistance (MOhm), time constant (ms) and capacitance (pF) from the current (pA) of a voltage step.

    The transient's decay is fitted as an exponential from 90 % of its height down to 10 %; run back to the
    apex it gives the access resistance, and its charge, made up for what the membrane leaks, the capacitance.
    """
    none = dict.fromkeys(("access", "membrane", "tau", "capacitance"))
    on = np.flatnonzero((t >= start) & (t < end))
    if len(on) < 8 or not step_mv or not (t < start).any():
        return none
    base, steady = i[t < start].mean(), np.median(i[on[int(0.8 * len(on)) :]])
    up = 1.0 if step_mv > 0 else -1.0
    excess = (i[on] - steady) * up
    apex = int(np.argmax(excess[: max(2, int(np.searchsorted(t[on], start + 0.002)))]))
    fall = np.flatnonzero(excess[apex:] < 0.1 * excess[apex])
    stop = apex + (int(fall[0]) if len(fall) else len(on) - apex)
    part = np.arange(apex, stop)[excess[apex:stop] <= 0.9 * excess[apex]]
    if len(part) < 3 or steady == base:
        return none
    rate, level = np.polyfit(t[on[part]] - t[on[apex]], np.log(excess[part]), 1)
    if rate >= 0:
        return none
    access = step_mv / (up * np.exp(level) + steady - base) * 1000
    membrane = step_mv / (steady - base) * 1000 - access
    charge = up * np.exp(level) / -rate * 1000  # fC
    return {"access": float(access), "membrane": float(membrane), "tau": float(-1000 / rate), "capacitance": float(charge / step_mv * ((access + membrane) / membrane) ** 2) if membrane > 0 else None}


# Images


def otsu(pixels: np.ndarray, bins: int = 256) -> float:
    h, e = np.histogram(pixels, bins)
    c, w = (e[:-1] + e[1:]) / 2, np.cumsum(h)
    m = np.cumsum(h * c)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return float(c[int(np.nanargmax(between[:-1]))])


def objects(plane: np.ndarray, threshold: float | None = None, least: int = 4) -> list[dict]:
    """4-connected regions over the threshold (Otsu's unless given): label, area, centroid, mean."""
    mask = plane > (otsu(plane) if threshold is None else threshold)
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        new[1:] = np.where(mask[1:], np.maximum(new[1:], label[:-1]), 0)
        new[:-1] = np.where(mask[:-1], np.maximum(new[:-1], label[1:]), 0)
        new[:, 1:] = np.where(mask[:, 1:], np.maximum(new[:, 1:], label[:, :-1]), 0)
        new[:, :-1] = np.where(mask[:, :-1], np.maximum(new[:, :-1], label[:, 1:]), 0)
        if (new == label).all():
            break
        label = new
    out = []
    for k, v in enumerate(np.unique(label[label > 0]), 1):
        y, x = np.nonzero(label == v)
        if len(y) >= least:
            out.append({"label": k, "area": len(y), "y": float(y.mean()), "x": float(x.mean()), "mean": float(plane[y, x].mean())})
    return out


def sharpness(plane: np.ndarray) -> float:
    """Variance of the Laplacian after averaging blocks down to 256 pixels at most."""
    k = max(1, -(-max(plane.shape) // 256))
    h, w = (s // k * k for s in plane.shape)
    p = plane[:h, :w].reshape(h // k, k, w // k, k).mean((1, 3))
    lap = p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1] - 4 * p[1:-1, 1:-1]
    return float(lap.var())


def line_profile(plane: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> np.ndarray:
    """Bilinear samples a pixel apart from a to b, as (y, x)."""
    n = int(np.hypot(b[0] - a[0], b[1] - a[1])) + 1
    y, x = np.linspace(a[0], b[0], n), np.linspace(a[1], b[1], n)
    y0, x0 = np.clip(np.floor(y).astype(int), 0, plane.shape[0] - 2), np.clip(np.floor(x).astype(int), 0, plane.shape[1] - 2)
    fy, fx = y - y0, x - x0
    return plane[y0, x0] * (1 - fy) * (1 - fx) + plane[y0 + 1, x0] * fy * (1 - fx) + plane[y0, x0 + 1] * (1 - fy) * fx + plane[y0 + 1, x0 + 1] * fy * fx


# Fragment sizing


def local_southern(t: float, ladder_t: np.ndarray, ladder_bp: np.ndarray) -> float | None:
    """Size at t as the mean of the two circles through three ladder peaks around it."""
    i = int(np.searchsorted(ladder_t, t))
    if i < 2 or i > len(ladder_t) - 2:
        return None

    def one(k: list[int]) -> float:
        (m1, m2, m3), (l1, l2, l3) = ladder_t[k], ladder_bp[k]
        r = ((l1 - l2) * (m3 - m2)) / ((l2 - l3) * (m2 - m1))
        if abs(1 - r) < 1e-9:  # on a line
            return l2 + (t - m2) * (l3 - l1) / (m3 - m1)
        m0 = (m3 - m1 * r) / (1 - r)
        c = (l1 - l2) / (1 / (m1 - m0) - 1 / (m2 - m0))
        return c / (t - m0) + l1 - c / (m1 - m0)

    return float((one([i - 2, i - 1, i]) + one([i - 1, i, i + 1])) / 2)
