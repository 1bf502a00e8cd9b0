"""Catalog rows: preservation, groups of files, series, completeness, comparison, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from .graph import connected_components

#: Openly specified formats, and those whose software is no longer made.
OPEN = ["tiff", "ome-zarr", "mzml", "mzxml", "imzml", "mzmlb", "fcs", "jcamp-dx", "andi-chrom", "nwb", "hdf5", "mrc", "emd", "plate", "spikeglx"]
LEGACY = ["zvi", "ser"]


def preservation(format_: Column) -> Column:
    f = F.lower(format_)
    return F.when(f.isin(OPEN), "open").when(f.isin(LEGACY), "legacy").when(f.isNotNull(), "vendor")


def grouped_files(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Data sets of several files: claims (path, member) are edges; the primary is readable, has most members, comes first."""
    comp = connected_components(claims.select(F.col("path").alias("a"), F.col("member").alias("b")))
    sizes = claims.groupBy("path").agg(F.count_distinct("member").alias("members"))
    rows = files.join(comp.withColumnRenamed("id", "path"), "path", "left").join(sizes, "path", "left")
    rows = rows.withColumn("component", F.coalesce("component", "path"))
    best = F.max_by("path", F.struct(F.col("ok"), F.coalesce("members", F.lit(0)), -F.col("seq")))
    return rows.groupBy("component").agg(best.alias("primary"), F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"))


def problems(df: DataFrame, id_: str, findings: str) -> DataFrame:
    """A row per finding (an array of code, severity, message)."""
    return df.select(id_, F.explode(findings).alias("f")).select(id_, "f.*")


def series_totals(df: DataFrame, key: list[str], order: str, counts: list[str]) -> DataFrame:
    """The first stream of each series with the counts of all of them."""
    return df.groupBy(*key).agg(F.min(order).alias(order), F.count("*").alias("streams"), *(F.sum(c).alias(c) for c in counts))


def missing_planes(df: DataFrame, key: list[str], dims: list[str]) -> DataFrame:
    """Of each plate the combinations of its own dimension values that aren't there: counts, without building the grid."""
    return df.groupBy(*key).agg(F.count_distinct(*dims).alias("present"), *(F.count_distinct(d).alias(f"n_{d}") for d in dims)).withColumn("missing", _product([F.col(f"n_{d}") for d in dims]) - F.col("present")).drop(*(f"n_{d}" for d in dims))


def _product(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return out


def session(left: DataFrame, right: DataFrame, on: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Traces of one recording on the same grid as columns of one table."""
    a, b = left.select(*on, F.col(value).alias(names[0])), right.select(*on, F.col(value).alias(names[1]))
    return a.join(b, on, "full")


def compare(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 0.0) -> DataFrame:
    """key, column, left, right for every cell that differs; rows of one side have all their cells."""
    cols = [c for c in a.columns if c not in key and c in b.columns]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, *(F.col(c).cast("string").alias(c) for c in cols)).unpivot(key, cols, "column", name)

    j = long(a, "left").join(long(b, "right"), [*key, "column"], "full")
    x, y = F.col("left").try_cast("double"), F.col("right").try_cast("double")
    same = F.col("left").eqNullSafe(F.col("right")) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
    return j.where(~same)


def json_compare(a: DataFrame, b: DataFrame, key: str, json: str, ignore: list[str] | None = None) -> DataFrame:
    """Differences of flat JSON objects by pointer."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("k", name)).select(key, F.concat(F.lit("/"), "k").alias("pointer"), name)

    j = long(a, "left").join(long(b, "right"), [key, "pointer"], "full").where(~F.col("left").eqNullSafe(F.col("right")))
    return j.where(~F.col("pointer").isin(ignore)) if ignore else j


def strict(df: DataFrame, assurance: str = "assurance", allowed: tuple[str, ...] = ("validated",)) -> DataFrame:
    """df if all its rows are assured; otherwise an error with how many are not."""
    bad = df.where(~F.coalesce(F.col(assurance).isin(*allowed), F.lit(False))).count()
    if bad:
        raise EngineError(f"{bad} rows without assurance", f"allowed: {', '.join(allowed)}")
    return df


def integrity(items: DataFrame, findings: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """A row per item: ok (no error among its findings), errors, warnings, infos. One aggregate, then one join."""
    counts = findings.groupBy(key).agg(*(F.count_if(F.lower(severity) == s).alias(f"{s}s") for s in ("error", "warning", "info")))
    out = items.select(key).distinct().join(counts, key, "left").na.fill(0, ["errors", "warnings", "infos"])
    return out.select(key, (F.col("errors") == 0).alias("ok"), "errors", "warnings", "infos")


def image_summary(images: DataFrame, key: list[str]) -> DataFrame:
    """Per data set the number of images and the sizes of the largest plane (of equals the lowest index, then the larger sizes)."""
    sizes = [c for c in ("size_x", "size_y", "size_z", "size_c", "size_t", "pixel_type") if c in images.columns]
    largest = F.max_by(F.struct(*sizes), F.struct(F.col("size_x") * F.col("size_y"), -F.col("index"), *sizes)).alias("l")
    return images.groupBy(*key).agg(F.count("*").alias("image_count"), largest).select(*key, "image_count", "l.*")


#: Licences by what their texts hold, the first that fits.
LICENCES = {
    "CC0-1.0": ["cc0 1.0", "cc0-1.0", "creative commons zero", "cc0"],
    "CC-BY-4.0": ["cc-by-4.0", "cc by 4.0", "creative commons attribution 4.0"],
    "CC-BY-SA-4.0": ["cc-by-sa-4.0", "attribution-sharealike 4.0"],
    "CC-BY-NC-4.0": ["cc-by-nc-4.0", "attribution-noncommercial 4.0"],
    "CC-BY-3.0": ["cc-by-3.0", "creative commons attribution 3.0"],
    "ODbL-1.0": ["odbl", "open database license"],
    "Apache-2.0": ["apache license, version 2.0", "apache-2.0", "apache license 2.0"],
    "MIT": ["mit license", "permission is hereby granted, free of charge"],
    "BSD-3-Clause": ["bsd-3-clause", "neither the name of the copyright holder"],
    "PDDL-1.0": ["pddl", "public domain dedication and license"],
}


def licence(text: Column) -> Column:
    """The SPDX id of a licence's text, else null."""
    t = F.lower(text)
    narrower = t.contains("sharealike") | t.contains("noncommercial")
    tests = {k: reduce(lambda a, b: a | b, [t.contains(p) for p in phrases]) for k, phrases in LICENCES.items()}
    return F.coalesce(*(F.when(p & ~narrower if k == "CC-BY-4.0" else p, F.lit(k)) for k, p in tests.items()))
