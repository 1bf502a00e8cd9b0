"""The value rules that differ from SQL: one place, as Column -> Column.

Non-finite numbers are null; a predicate on a null never holds and its negation does;
group keys sort in natural order; numbers in text are plain decimals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A plain decimal: no thousands separators, no NaN or inf, 64 characters at most.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def finite(c: Column) -> Column:
    """NaN and the infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def holds(p: Column) -> Column:
    """A predicate without a third value."""
    return F.coalesce(p, F.lit(False))


def number(text: Column) -> Column:
    """The number that a text plainly is, else null."""
    t = F.trim(text)
    return F.when((F.length(t) <= 64) & t.rlike(NUMBER), t.try_cast("double"))


def as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, NUMERIC):
        return finite(F.col(name))
    return number(F.col(name)) if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    """Shortest text: integral numbers without a point."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        f = finite(c)
        return F.when(f == F.floor(f), F.floor(f).cast("string")).otherwise(f.cast("string"))
    return c.cast("string")


def cell_equals(df: DataFrame, name: str, value: str) -> Column:
    """Numeric where both are numbers, else trimmed text without case; an empty value asks for null or empty."""
    text = F.lower(F.trim(as_text(df, name)))
    if not value.strip():
        return F.coalesce(text == "", F.lit(True))
    plain = holds(text == value.strip().lower())
    try:
        v = float(value)
    except ValueError:
        return plain
    n = as_number(df, name)
    return holds(F.when(n.isNotNull(), n == v).otherwise(plain))


def near(a: Column, b: Column) -> Column:
    """Equality of the catalog's numbers: relative 1e-9, absolute under 1."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def natural_key(c: Column) -> Column:
    """Sorts digit runs as numbers (of up to 99,999 digits, the length first) and letters without case; ties are for the raw text to break."""
    t = F.lower(c.cast("string"))
    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(F.regexp_replace(x, "^0+(?=.)", "")).cast("string"), 5, "0"), F.regexp_replace(x, "^0+(?=.)", ""))).otherwise(x)), "")


def normal_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normal_path(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\\", "/"))


def alphanumeric(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)/*$", 1)


#: Extensions of two parts, which come off as one.
COMPOUND = [".ome.tiff", ".ome.tif", ".ome.btf", ".ome.tf2", ".ome.tf8", ".ome.zarr", ".asm.json", ".companion.ome", ".mzml.gz", ".mzxml.gz"]


def whole_stem(path: Column) -> Column:
    """The file name without its extension, a compound one included."""
    name = F.regexp_replace(file_name(path), "(?i)(?<=.)(" + "|".join(c.replace(".", r"\.") for c in COMPOUND) + ")$", "")
    return F.when(name != file_name(path), name).otherwise(stem(path))


def stem(path: Column, times: int = 1) -> Column:
    """The file name without its last extensions."""
    return reduce(lambda c, _: F.regexp_replace(c, r"(?<=.)\.[A-Za-z0-9_]+$", ""), range(times), file_name(path))


def directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/?[^/]*/*$", "")


def _let(c: Column, f) -> Column:
    """f of c, which is worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _place(c: Column) -> Column:
    """Row and column (r, k), from 1, of a well; null where it is none. Each pattern is matched once."""
    groups = lambda t: F.array(*(F.regexp_extract(t, p, i) for p in (r"^([A-Z]{1,2})[-_ ]?0*(\d{1,2})$", r"^R0*(\d{1,2})C0*(\d{1,2})$") for i in (1, 2)))

    def numbers(g: Column) -> Column:
        letters, digits, r, k = (g[i] for i in range(4))
        row = F.when(r != "", r.try_cast("int")).when(F.length(letters) == 1, F.ascii(letters) - 64).when(F.length(letters) == 2, (F.ascii(letters) - 64) * 26 + F.ascii(F.substring(letters, 2, 1)) - 64)
        return F.struct(row.alias("r"), F.when(r != "", k.try_cast("int")).otherwise(digits.try_cast("int")).alias("k"))

    on_plate = lambda p: F.when(p["r"].between(1, 32) & p["k"].between(1, 48), p)
    return _let(F.upper(F.trim(c)), lambda t: _let(groups(t), lambda g: _let(numbers(g), on_plate)))


def _well_name(r: Column, k: Column) -> Column:
    return F.concat(F.when(r <= 26, F.chr(64 + r)).otherwise(F.concat(F.lit("A"), F.chr(64 + r - 26))), F.lpad(k.cast("string"), 2, "0"))


def well(c: Column) -> Column:
    """A1, a01, A-1 and R1C1 as A01; null where it is none (32 rows and 48 columns at most)."""
    return _let(_place(c), lambda p: _well_name(p["r"], p["k"]))


def cv_percent(mean: Column, sd: Column) -> Column:
    return F.when(mean != 0, F.try_divide(sd, F.abs(mean)) * 100)


def leading_number(text: Column) -> tuple[Column, Column]:
    """(number, rest) of `1.5 mg/ml`; null where no plain number stands before something else."""
    t = F.trim(text)
    head = F.regexp_extract(t, r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?![0-9.eE])", 1)
    value = F.when(head != "", finite(head.try_cast("double")))
    return value, F.when(value.isNotNull(), F.trim(F.substring(t, F.length(head) + 1, F.length(t))))


def dilution(text: Column) -> Column:
    """The factor that `1:10`, `1/10`, `10x` or `10` says; a plain number under 1 is a fraction."""
    t = F.trim(text)
    a, b = (number(F.regexp_extract(t, r"^([^:/]*)[:/](.*)$", k)) for k in (1, 2))
    v = number(F.regexp_replace(t, "[xX]+$", ""))
    return F.when(t.rlike("[:/]"), F.when((a > 0) & (b > 0), b / a)).when(v > 0, F.when(v < 1, 1 / v).otherwise(v))


def well_range(c: Column) -> Column:
    """The wells of `A1:B3`, row by row, whichever corners it names; one well is itself, anything else null."""
    ends = F.when(c.contains(":"), F.array(F.regexp_extract(c, r"^([^:]*)", 1), F.regexp_extract(c, r"^[^:]*:(.*)$", 1))).otherwise(F.array(c))

    def wells(p: Column) -> Column:
        a, b = p[0], F.element_at(p, -1)
        rows, columns = (F.sequence(F.least(a[x], b[x]), F.greatest(a[x], b[x])) for x in "rk")
        return F.when(a.isNotNull() & b.isNotNull(), F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda k: _well_name(r, k)))))

    return _let(F.transform(ends, _place), wells)


#: Rows and columns of the usual plates.
PLATES = [(2, 3), (3, 4), (4, 6), (6, 8), (8, 12), (16, 24), (32, 48)]


def plate_size(rows: Column, columns: Column) -> Column:
    """Wells of the smallest usual plate that has so many rows and columns."""
    return F.coalesce(*(F.when((rows <= r) & (columns <= k), F.lit(r * k)) for r, k in PLATES))
