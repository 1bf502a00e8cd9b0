"""Quantities with units, dates of any precision, byte counts for people."""

from __future__ import annotations

import datetime as dt
import re

#: Unit suffixes and their factor to the column's base unit.
UNITS = {
    "bytes": {"b": 1.0, "k": 1e3, "kb": 1e3, "m": 1e6, "mb": 1e6, "g": 1e9, "gb": 1e9, "t": 1e12, "tb": 1e12, "p": 1e15, "pb": 1e15, "kib": 2.0**10, "mib": 2.0**20, "gib": 2.0**30, "tib": 2.0**40, "pib": 2.0**50},
    "seconds": {"us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "sec": 1.0, "m": 60.0, "min": 60.0, "h": 3600.0, "hr": 3600.0, "hours": 3600.0, "d": 86400.0, "day": 86400.0, "days": 86400.0},
    "hertz": {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9},
    "micrometres": {"nm": 1e-3, "um": 1.0, "µm": 1.0, "μm": 1.0, "micron": 1.0, "microns": 1.0, "mm": 1e3, "a": 1e-4, "å": 1e-4},
    "magnification": {"x": 1.0},
}


def quantity(text: str, unit: str | None = None) -> float | None:
    """'63x', '1.5GB', '10 min' in the base unit of its class; null if it isn't one."""
    m = re.fullmatch(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\s*(\S*)\s*", text, re.IGNORECASE)
    if not m:
        return None
    suffix = m[2].lower()
    if not suffix:
        return float(m[1])
    factor = UNITS.get(unit or "", {}).get(suffix)
    return None if factor is None else float(m[1]) * factor


def date_range(text: str) -> tuple[dt.datetime, dt.datetime] | None:
    """[start, end) in UTC of a year, month, day, minute or second."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?Z?)?)?)?", text.strip())
    if not m:
        return None
    y, mo, d, h, mi, s = (int(x) if x else None for x in m.groups())
    try:
        start = dt.datetime(y, mo or 1, d or 1, h or 0, mi or 0, s or 0)
        if mo is None:
            return start, dt.datetime(y + 1, 1, 1)
        if d is None:
            return start, dt.datetime(y + mo // 12, mo % 12 + 1, 1)
    except ValueError:
        return None
    step = dt.timedelta(days=1) if h is None else dt.timedelta(minutes=1) if s is None else dt.timedelta(seconds=1)
    return start, start + step


def since(text: str, now: dt.datetime) -> dt.datetime | None:
    """'90s', '10m', '2h', '3d' ago; 'all' for no bound."""
    if text.strip().lower() == "all":
        return None
    v = quantity(text, "seconds")
    if v is None:
        raise ValueError(f"not a duration: {text}")
    return now - dt.timedelta(seconds=v)


def human_bytes(n: int) -> str:
    v, k = float(n), 0
    while v >= 1000 and k < 5:
        v, k = v / 1000, k + 1
    return f"{n} B" if not k else f"{v:.1f} {'kMGTP'[k - 1]}B"
