"""The batch plan: measure -> join a sheet -> filter -> fields -> summarize -> write; and named analyses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..errors import UsageError
from ..operators import assay, joins, qpcr, series, signal, summarize, tables
from ..sources.tables import save_table


class Measure:
    """A plug-in that makes tidy rows of a source DataFrame; options are checked by name."""

    id = ""
    options: dict[str, type] = {}

    def rows(self, source: DataFrame, **options) -> DataFrame:
        raise NotImplementedError


MEASURES: dict[str, Measure] = {}


def measure(cls: type[Measure]) -> type[Measure]:
    MEASURES[cls.id] = cls()
    return cls


def run_measure(name: str, source: DataFrame, **options) -> DataFrame:
    if name not in MEASURES:
        raise UsageError(f"no measure {name}", ", ".join(sorted(MEASURES)))
    m = MEASURES[name]
    for k, v in options.items():
        if k not in m.options or not isinstance(v, m.options[k]):
            raise UsageError(f"{name} takes no {k}={v!r}", ", ".join(m.options) or "no options")
    return m.rows(source, **options)


@measure
class Trace(Measure):
    id, options = "trace", {"keys": list, "x": str, "y": str}

    def rows(self, source, keys, x="t", y="value"):
        return series.trace_statistics(source, keys, x, y)


@measure
class Stats(Measure):
    id, options = "stats", {"keys": list, "value": str, "saturated": float}

    def rows(self, source, keys, value="value", saturated=65535.0):
        return series.pixel_statistics(source, keys, value, saturated)


@measure
class Table(Measure):
    id, options = "table", {"keys": list, "columns": list}

    def rows(self, source, keys, columns):
        return series.parameter_summary(source, keys, columns)


ANALYSES: dict[str, Callable[..., DataFrame]] = {
    "peaks": signal.peaks,
    "spikes": lambda df, keys, t, v, **k: signal.per_trace(df, keys, [t, v], lambda a, b: signal.extracellular(a, b, **k), "t double, amplitude double"),
    "ephys-features": lambda df, keys, t, v, **k: signal.per_trace(df, keys, [t, v], lambda a, b: signal.spikes(a, b, **k), "t double, threshold double, peak double, amplitude double, half_width double, trough double"),
    "nmr-peaks": lambda df, keys, ppm, y, **k: signal.per_trace(df, keys, [ppm, y], lambda a, b: signal.nmr_peaks(a, b, **k), "ppm double, height double"),
    "kinetics": assay.kinetics,
    "growth": assay.growth,
    "curve": assay.fit,
    "assay-qc": assay.quality,
    "cq": qpcr.threshold_cq,
    "ddcq": qpcr.delta_delta_cq,
    "standard-curve": qpcr.standard_curve,
}


def analyze(kind: str, df: DataFrame, *args, **options) -> DataFrame:
    if kind not in ANALYSES:
        raise UsageError(f"no analysis {kind}", ", ".join(sorted(ANALYSES)))
    return ANALYSES[kind](df, *args, **options)


@dataclass
class Batch:
    """`run` gives the table; `report` is the sheet join's, once run."""

    source: DataFrame
    measure: str | None = None
    options: dict = field(default_factory=dict)
    sheet: DataFrame | None = None
    keys: list[tuple[str, str]] | None = None
    where: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    by: list[str] = field(default_factory=list)
    values: list[str] = field(default_factory=list)
    summary: dict = field(default_factory=dict)
    report: joins.Report | None = None

    def run(self) -> DataFrame:
        df = run_measure(self.measure, self.source, **self.options) if self.measure else self.source
        if self.sheet is not None:
            df, self.report = joins.sheet_join(df, self.sheet, self.keys)
        df = tables.tidy_filter(df, *self.where)
        if self.by:
            df = summarize.summarize(df, self.by, self.values, **self.summary)
        return tables.fields(df, self.fields) if self.fields else df

    def save(self, path: str, **options) -> None:
        save_table(self.run(), path, **options)
