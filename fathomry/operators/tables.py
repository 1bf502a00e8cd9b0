"""Tidy tables: typing, assembly, projection, filters, slices, paging."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import semantics as S
from ..errors import UsageError
from .graph import checkpointed

#: Columns a projection always keeps, and the order of column roles.
ALWAYS = ("path", "format", "error", "error_code")
ROLES = ("id", "key", "annotation", "metadata", "value", "error")


def typed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns become long, double or boolean if every filled cell is one: a single aggregate decides for all."""
    names = [c for c, kind in df.dtypes if kind == "string" and (columns is None or c in columns)]
    if not names:
        return df
    filled = {c: F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))) for c in names}
    tests = {"long": r"^[+-]?[0-9]{1,18}$", "double": S.NUMBER, "boolean": r"^(?i:true|false)$"}
    row = df.agg(*(F.coalesce(F.bool_and(v.rlike(p)), F.lit(False)).alias(f"{k}:{c}") for c, v in filled.items() for k, p in tests.items())).first()
    kinds = {c: next((k for k in tests if row[f"{k}:{c}"]), None) for c in names}
    return df.withColumns({c: filled[c].try_cast(k) for c, k in kinds.items() if k})


def assemble(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns, by role and then first seen."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    roles = {}
    for f in frames:
        for field in f.schema:
            roles.setdefault(field.name, field.metadata.get("role", "value"))
    order = sorted(roles, key=lambda c: ROLES.index(roles[c]) if roles[c] in ROLES else len(ROLES))
    return out.select(*order)


def with_role(df: DataFrame, **roles: str) -> DataFrame:
    for name, role in roles.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "role": role})
    return df


def fields(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in order, and those that every table keeps."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise UsageError(f"no column {', '.join(unknown)}", f"columns: {', '.join(df.columns)}")
    keep = [c for c in ALWAYS if c in df.columns and c not in names]
    return df.select(*[c for c in keep if c in ("path", "format")], *names, *[c for c in keep if c not in ("path", "format")])


def tidy_filter(df: DataFrame, *conditions: str) -> DataFrame:
    """`col=value` and `col!=value`, all of them; != keeps rows without a value."""
    for c in conditions:
        m = re.fullmatch(r"\s*(.+?)\s*(!=|=)(.*)", c)
        if not m or m[1] not in df.columns:
            raise UsageError(f"not a condition on a column: {c}", f"columns: {', '.join(df.columns)}")
        same = S.cell_equals(df, m[1], m[3])
        df = df.where(~same if m[2] == "!=" else same)
    return df


def row_predicate(df: DataFrame, expression: str) -> Column:
    """`col OP number && ...` over numbers; a NaN or null fails every comparison, != too."""
    out = F.lit(True)
    for part in re.split(r"\s*&&\s*|\s+and\s+", expression.strip(), flags=re.IGNORECASE):
        m = re.fullmatch(r"(.+?)\s*(>=|<=|==|!=|=|>|<)\s*([+-]?[0-9.eE+-]+)", part)
        if not m or m[1] not in df.columns:
            raise UsageError(f"not a comparison of a column with a number: {part}")
        c, v = S.as_number(df, m[1]), float(m[3])
        test = {">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v, "==": c == v, "=": c == v, "!=": c != v}[m[2]]
        out = out & S.holds(test)
    return out


def count_rows(df: DataFrame, expression: str) -> DataFrame:
    """matched, total, percent of a row filter in one pass."""
    p = row_predicate(df, expression)
    return df.agg(F.count_if(p).alias("matched"), F.count("*").alias("total")).withColumn("percent", F.try_divide(F.col("matched") * 100.0, F.col("total")))


def scan_filter(scans: DataFrame, *, ms_level: int | None = None, polarity: str | None = None, rt_min: float | None = None, rt_max: float | None = None, precursor: float | None = None, ppm: float | None = None, da: float = 0.01, charge: int | None = None, activation: str | None = None, contains: str | None = None) -> DataFrame:
    """Spectra by header; all conditions hold together."""
    tests = []
    if ms_level is not None:
        tests.append(F.col("ms_level") == ms_level)
    if polarity:
        tests.append(F.lower("polarity") == polarity.lower())
    if rt_min is not None:
        tests.append(F.col("rt_min") >= rt_min)
    if rt_max is not None:
        tests.append(F.col("rt_min") <= rt_max)
    if precursor is not None:
        width = precursor * ppm * 1e-6 if ppm is not None else da
        tests.append(F.col("precursor_mz").between(precursor - width, precursor + width))
    if charge is not None:
        tests.append(F.col("precursor_charge") == charge)
    if activation:
        tests.append(F.lower("activation") == activation.lower())
    if contains:
        tests.append(F.contains(F.lower("scan_filter"), F.lit(contains.lower())))
    return scans.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def slice_rows(df: DataFrame, order: list[str], first_row: int, max_rows: int) -> DataFrame:
    """A page of an ordered table."""
    return df.orderBy(*order).offset(first_row).limit(max_rows)


def nearest(df: DataFrame, key: list[str], by: str, at: float) -> DataFrame:
    """For each key the row whose `by` is nearest to a value, the smaller on a tie."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(F.abs(F.col(by) - at), F.col(by))).alias("r")
    return df.groupBy(*key).agg(best).select(*key, "r.*")


def as_of(left: DataFrame, right: DataFrame, key: list[str], on: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before it: a union and one window, no pairs."""
    a = left.withColumn("__side", F.lit(1))
    b = right.select(*key, on, *values).withColumn("__side", F.lit(0))
    for v in values:
        b = b.withColumnRenamed(v, f"__{v}")
    w = Window.partitionBy(*key).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    last = F.last(F.when(F.col("__side") == 0, F.struct(*(F.col(f"__{v}").alias(v) for v in values))), ignorenulls=True).over(w)
    return both.withColumn("__r", last).where("__side = 1").select(*left.columns, *(F.col(f"__r.{v}").alias(v) for v in values))


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """A sorted page with the total; limit 0 for all rows."""
    total = df.agg(F.count("*").alias("total"))
    top = df.orderBy(*order)
    top = top.offset(offset) if offset else top
    return (top.limit(limit) if limit else top).crossJoin(F.broadcast(total))  # one row


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with each row's place in the whole order, from 1: ranges of the key are sorted apart and get the sum of the counts before them."""
    low = (1 << 33) - 1
    rows = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright("__i", 33)
    before, total = [], 0
    for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        before += [F.lit(r["p"]), F.lit(total)]
        total += r["n"]
    if not total:
        return rows.select(*df.columns, F.lit(0).cast("long").alias(name))
    return rows.select(*df.columns, (F.col("__i").bitwiseAND(F.lit(low)) + 1 + F.element_at(F.create_map(*before), part)).cast("long").alias(name))


def planes(df: DataFrame, *selections: str) -> DataFrame:
    """Planes by `c=0,1`, `z=2-5` or both as `c=0,1,z=2-5`; an axis that no selection names is not restricted."""
    wanted: dict[str, list[Column]] = {}
    for one in (x for s in selections for x in re.split(r",\s*(?=[^,=]+=)", s)):
        m = re.fullmatch(r"\s*([cztCZT])\s*=\s*(\d+(?:\s*-\s*\d+)?(?:\s*,\s*\d+(?:\s*-\s*\d+)?)*)\s*", one)
        if not m:
            raise UsageError(f"not a selection of planes: {one}", "axes c, z and t, such as z=0-3")
        for part in m[2].split(","):
            low, high = (int(x) for x in (part.split("-") * 2)[:2])
            if high < low:
                raise UsageError(f"range {part.strip()} is reversed")
            wanted.setdefault(m[1].lower(), []).append(F.col(m[1].lower()).between(low, high))
    return df.where(reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, tests) for tests in wanted.values()], F.lit(True)))
