"""The catalog's query language, compiled to one Column.

Terms are ANDed, OR separates alternatives; `field:value`, `=`, `!=`, `~`, `!~`, `<`, `<=`,
`>`, `>=`; a leading - or ! negates; a|b means either; bare words look through the text
columns. A cell without a value matches nothing, and its negation does match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import semantics as S
from ..errors import UsageError
from ..functions.units import date_range, quantity

#: Query fields and the catalog columns that each stands for.
FIELDS = {
    "sample": ["sample_id", "sample_name", "sample_well", "sample_barcode", "sample_position"],
    "well": ["sample_well"],
    "barcode": ["sample_barcode"],
    "instrument": ["instrument_vendor", "instrument_model", "instrument_serial"],
    "vendor": ["instrument_vendor", "format_vendor"],
    "model": ["instrument_model"],
    "serial": ["instrument_serial"],
    "software": ["instrument_software", "instrument_software_version"],
    "device": ["instrument_kind_id", "instrument_kind_label"],
    "method": ["method_name"],
    "technique": ["technique_id", "technique_label"],
    "assay": ["assay_id", "assay_label"],
    "term": ["terms", "term_labels"],
    "acquired": ["started_at"],
    "date": ["started_at"],
    "year": ["acquired_year"],
    "duration": ["duration_s"],
    "what": ["what"],
    "channel": ["channels", "table_columns"],
    "objective": ["objective_magnification", "objective"],
    "na": ["objective_na"],
    "pixel": ["physical_size_x_um"],
    "z_step": ["physical_size_z_um"],
    "x": ["size_x"],
    "y": ["size_y"],
    "z": ["size_z"],
    "c": ["size_c"],
    "t": ["size_t"],
    "images": ["image_count"],
    "planes": ["plane_count"],
    "rows": ["table_rows"],
    "events": ["table_rows"],
    "columns": ["table_columns"],
    "traces": ["trace_count"],
    "rate": ["sample_rate_hz"],
    "sweeps": ["trace_sweeps"],
    "scans": ["scan_count"],
    "ms_level": ["ms_levels"],
    "rt": ["rt_max_s"],
    "size": ["size_bytes"],
    "modified": ["mtime"],
    "status": ["check_status"],
    "check": ["check_status"],
    "problem": ["check_codes", "error_code"],
    "pii": ["pii_kinds"],
    "risk": ["preservation"],
}
#: Where a bare word is looked for, and the unit class of numeric columns.
TEXT_COLUMNS = ["path", "sample_id", "sample_name", "method_name", "what", "channels", "instrument_model", "technique_label", "format", "operator"]
UNIT_OF = {"size_bytes": "bytes", "duration_s": "seconds", "time_increment_s": "seconds", "rt_min_s": "seconds", "rt_max_s": "seconds", "sample_rate_hz": "hertz", "physical_size_x_um": "micrometres", "physical_size_y_um": "micrometres", "physical_size_z_um": "micrometres", "objective_magnification": "magnification"}


def tokens(query: str) -> list[str]:
    """Split at white space outside quotes; the quotes go."""
    out, cur, quote, any_ = [], "", "", False
    for ch in query:
        if quote:
            quote, cur = ("", cur) if ch == quote else (quote, cur + ch)
        elif ch in "\"'":
            quote, any_ = ch, True
        elif ch.isspace():
            if cur or any_:
                out.append(cur)
            cur, any_ = "", False
        else:
            cur += ch
    if quote:
        raise UsageError(f"unbalanced {quote} in the query")
    return [*out, cur] if cur or any_ else out


class Search:
    """Compiles queries for one table; fields: extra names beside the catalog's (name -> columns)."""

    def __init__(self, df: DataFrame, fields: dict[str, list[str]] | None = None, text: list[str] | None = None, units: dict[str, str] | None = None):
        self.df, self.fields = df, {**FIELDS, **(fields or {})}
        self.text = [c for c in (text or TEXT_COLUMNS) if c in df.columns]
        self.units = {**UNIT_OF, **{f.name: f.metadata["unit_class"] for f in df.schema if "unit_class" in f.metadata}, **(units or {})}

    def compile(self, query: str) -> Column:
        groups: list[list[Column]] = [[]]
        for t in tokens(query):
            if t == "OR":
                groups.append([])
            elif t != "AND":
                groups[-1].append(self._term(t))
        if not any(groups):
            return F.lit(True)
        if not all(groups):
            raise UsageError("OR needs a term on both sides")
        return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups))

    def _term(self, term: str) -> Column:
        negate = False
        while term[:1] in ("-", "!") and len(term) > 1:
            negate, term = not negate, term[1:]
        m = re.match(r"([A-Za-z_][\w.]*)(!=|!~|<=|>=|=|~|<|>|:)(.*)", term, re.DOTALL)
        if not m:
            return self._any([self._text(c, "~", v) for v in term.split("|") for c in self.text]) != F.lit(negate)
        field, op, value = m.groups()
        if op in ("!=", "!~"):
            negate, op = not negate, op[1]
        return self._any([self._field(field, op, v) for v in value.split("|")]) != F.lit(negate)

    @staticmethod
    def _any(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, (S.holds(t) for t in tests), F.lit(False))

    def _field(self, field: str, op: str, value: str) -> Column:
        if field.startswith("param."):
            return self._param(field[6:], op, value)
        if field == "pii" and value.lower() in ("true", "any", "false", "none") and "pii_count" in self.df.columns:
            some = F.coalesce(F.col("pii_count") > 0, F.lit(False))
            return some if value.lower() in ("true", "any") else ~some
        names = self.fields.get(field, [field])
        if field == "objective":
            names = names[:1] if quantity(value, "magnification") is not None else names[1:]
        names = [n for n in names if n in self.df.columns]
        if not names:
            raise UsageError(f"no field {field}", f"fields: {', '.join(sorted(self.fields))}")
        return self._any([self._column(n, op, value) for n in names])

    def _column(self, name: str, op: str, value: str) -> Column:
        kind = self.df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, S.NUMERIC):
                return F.exists(name, lambda x: self._number(x, op, quantity(value)))
            return F.exists(name, lambda x: self._match(x, op, value, name))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return self._date(F.col(name), op, value)
        if isinstance(kind, T.BooleanType):
            return F.col(name) == (value.lower() in ("true", "yes", "1"))
        if isinstance(kind, S.NUMERIC):
            return self._number(S.finite(F.col(name)), op, quantity(value, self.units.get(name)))
        return self._text(name, op, value)

    def _number(self, c: Column, op: str, v: float | None) -> Column:
        if v is None:
            return F.lit(False)
        same = S.near(c, F.lit(v))
        return {"<": (c < v) & ~same, ">": (c > v) & ~same, "<=": (c < v) | same, ">=": (c > v) | same}.get(op, same)

    def _date(self, c: Column, op: str, value: str) -> Column:
        r = date_range(value)
        if r is None:
            raise UsageError(f"not a date: {value}", "2024, 2024-05, 2024-05-17 or a time on a day")
        c = c.cast("timestamp_ntz")
        start, end = (F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") for x in r)
        return {"<": c < start, "<=": c < end, ">": c >= end, ">=": c >= start}.get(op, (c >= start) & (c < end))

    def _text(self, name: str, op: str, value: str) -> Column:
        if isinstance(self.df.schema[name].dataType, T.ArrayType):
            return F.exists(name, lambda x: self._match(x, op, value, name))
        return self._match(F.col(name).cast("string"), op, value, name)

    def _match(self, c: Column, op: str, value: str, name: str) -> Column:
        low, v = F.lower(c), value.lower()
        if name.endswith("_id") or name == "terms":  # FBbi_00000246 is FBBI:00000246
            low, v = F.regexp_replace(low, r"^([a-z]+)_", "$1:"), re.sub(r"^([a-z]+)_", r"\1:", v)
        if op in ("~", ":") and not (op == ":" and (name.endswith("_id") or name == "terms")):
            return F.contains(low, F.lit(v))
        if op in ("<", "<=", ">", ">="):
            n, q = S.number(c), quantity(value)
            by_text = {"<": low < v, "<=": low <= v, ">": low > v, ">=": low >= v}[op]
            return by_text if q is None else F.when(n.isNotNull(), self._number(n, op, q)).otherwise(by_text)
        return low == v

    def _param(self, key: str, op: str, value: str) -> Column:
        """A key of parameters_json without case: its `value`, or itself."""
        entries = F.map_entries(F.from_json("parameters_json", "map<string,string>"))

        def test(e: Column) -> Column:
            inner = F.coalesce(F.get_json_object(e["value"], "$.value"), e["value"])
            q = quantity(value)
            n = S.number(inner)
            by_text = self._match(inner, op, value, "")
            return (F.lower(e["key"]) == key.lower()) & S.holds(by_text if q is None or op in ("~", ":") else F.when(n.isNotNull(), self._number(n, op, q)).otherwise(by_text))

        return F.exists(entries, test)


def search(df: DataFrame, query: str, sort: str | None = None, limit: int = 50, offset: int = 0, tie: str = "path", **options) -> DataFrame:
    """Matching rows with the total and whether the page cuts them off: one filter, one top-k, one count."""
    s = Search(df, **options)
    hits = df.where(s.compile(query))
    down = bool(sort) and sort.startswith("-")
    name = (sort or "").lstrip("-")
    name = next((c for c in s.fields.get(name, [name]) if c in df.columns), None)
    if sort and not name:
        raise UsageError(f"cannot sort by {sort}")
    order = ([F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last()] if name else []) + ([F.col(tie)] if tie in df.columns else [])
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy(*order) if order else hits
    top = top.offset(offset) if offset else top
    out = (top.limit(limit) if limit else top).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("truncated", F.lit(bool(limit)) & (F.col("total") > offset + (limit or 0)))
