"""Joins of measurements with sample sheets, layouts and one another.

The auto-key join scores every (sheet column, row field) pair in one exploded equi-join
and one aggregate, then plans the real join with the best; sheets are broadcast only where
their size was checked.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import semantics as S
from ..errors import UsageError
from .graph import checkpointed
from .tables import positions

#: Row fields a sheet column may name, in order of preference, and the columns they come from.
KEY_FIELDS = {
    "path": "path",
    "file": "path",
    "stem": "path",
    "sample_id": "sample_id",
    "sample_name": "sample_name",
    "barcode": "sample_barcode",
    "well": "well",
    "position": "sample_position",
    "run_order": "started_at",
}
#: The place of a row by its start, numbered by ``sheet_join``.
ORDER = "__order"
#: How many rows share a key.
WEIGHT = "__weight"
#: Sheets of at most so many rows are sent to every executor.
BROADCAST_ROWS = 100_000
#: Glob cells in one pass over the distinct names.
GLOBS = 500


@dataclass
class Report:
    keys: list[tuple[str, str]]
    matched: int
    ambiguous: int
    unmatched_rows: DataFrame = field(repr=False)
    unmatched_sheet: DataFrame = field(repr=False)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if it has few rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def row_keys(df: DataFrame, name: str) -> Column:
    """All normalised keys of a row under a field: path suffixes, stems, or one value."""
    source = ORDER if name == "run_order" else KEY_FIELDS.get(name, name)
    if source not in df.columns:
        return F.array().cast("array<string>")
    c = F.col(source)
    if name == "path":
        p = S.normal_path(c)
        parts = F.split(p, "/")
        keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "/"))
    elif name == "file":
        keys = F.array(S.normal_text(S.file_name(c)))
    elif name == "stem":
        keys = F.array(*(S.normal_text(S.stem(c, k)) for k in (1, 2, 3)))
    elif name == "well":
        keys = F.array(S.well(c))
    elif name == "run_order":
        # numbered beforehand where a sheet may name it (`sheet_join`)
        keys = F.array(c.cast("string"))
    else:
        keys = F.array(S.normal_text(c.cast("string")))
    return F.array_distinct(F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def sheet_key(c: Column, name: str) -> Column:
    c = c.cast("string")
    return {"path": S.normal_path(c), "well": S.well(c), "run_order": F.regexp_extract(F.trim(c), r"^0*(\d+)$", 1)}.get(name, S.normal_text(c))


def choose_keys(rows: DataFrame, sheet: DataFrame, fields: list[str] | None = None, most: int = 2, row_id: str = "__row") -> list[tuple[str, str]]:
    """Pairs (sheet column, field) that match most rows; a further pair only if it lowers the rows matched twice."""
    fields = fields or [f for f in KEY_FIELDS if (ORDER if f == "run_order" else KEY_FIELDS[f]) in rows.columns]
    if not fields:
        return []
    weight = F.col(WEIGHT) if WEIGHT in rows.columns else F.lit(1)
    left = rows.select(row_id, weight.alias(WEIGHT), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), row_keys(rows, f).alias("ks")) for f in fields))).alias("x")).select(row_id, WEIGHT, "x.f", F.explode("x.ks").alias("k"))
    right = sheet.select("__sheet", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(f).alias("f"), sheet_key(F.col(f"`{c}`"), f).alias("k")) for c in sheet.columns if c != "__sheet" for f in fields))).alias("x")).select("__sheet", "x.*").where("k is not null and k <> ''")
    hits = left.join(sized(right), ["f", "k"]).select("c", "f", row_id, WEIGHT, "__sheet").distinct()
    each = hits.groupBy("c", "f", row_id, WEIGHT).agg(F.count("*").alias("n"))
    sums = F.coalesce(F.sum(WEIGHT), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col(WEIGHT))), F.lit(0)).alias("twice")
    score = each.groupBy("c", "f").agg(*sums).collect()  # columns * fields at most
    rank = {f: i for i, f in enumerate(fields)}
    place = {c: i for i, c in enumerate(sheet.columns)}
    best = sorted(score, key=lambda r: (-r["rows"], rank[r["f"]], place[r["c"]]))
    if not best:
        return []
    chosen, twice = [(best[0]["c"], best[0]["f"])], best[0]["twice"]
    for r in best[1:]:
        if len(chosen) > most or not twice:
            break
        if r["c"] in [c for c, _ in chosen] or r["rows"] < best[0]["rows"]:
            continue
        pairs = [*chosen, (r["c"], r["f"])]
        cond = F.lit(False)
        for c, f in pairs:
            cond = cond | ((F.col("c") == c) & (F.col("f") == f))
        per = hits.where(cond).groupBy(row_id, WEIGHT, "__sheet").agg(F.count("*").alias("m")).where(F.col("m") == len(pairs)).groupBy(row_id, WEIGHT).agg(F.count("*").alias("n")).agg(*sums).first()
        if per["rows"] >= best[0]["rows"] and per["twice"] < twice:
            chosen, twice = pairs, per["twice"]
    return chosen


def sheet_join(rows: DataFrame, sheet: DataFrame, keys: list[tuple[str, str]] | None = None) -> tuple[DataFrame, Report]:
    """Every row, with the annotations of the sheet row that it matches.

    Several sheet rows that agree count as one; if they disagree the annotations are
    null and the row is ambiguous. Rows are read twice, for their key fields and for the join, and not written. Sheet columns of a taken name get `_sheet`. Cells
    with * ? [ match as globs. A row's copies each get their annotation.
    """
    sheet = checkpointed(sheet.withColumn("__sheet", F.monotonically_increasing_id()))
    fields = [f for _, f in keys] if keys else [f for f in KEY_FIELDS if KEY_FIELDS[f] in rows.columns]
    ordered = "run_order" in fields and (keys or any(w in c.lower() for c in sheet.columns for w in ("order", "injection", "run", "seq", "acquisition")))
    if ordered:
        rows = positions(rows, [F.col(KEY_FIELDS["run_order"]).asc_nulls_last()], ORDER)
    # rows of equal key fields get the same: these are matched, once each, and met again by value
    on = [c for c in dict.fromkeys(ORDER if f == "run_order" else KEY_FIELDS.get(f, f) for f in fields) if c in rows.columns] or rows.columns[:1]
    tuples = checkpointed(rows.groupBy(*(F.col(f"`{c}`") for c in on)).agg(F.count("*").alias(WEIGHT)).withColumn("__row", F.monotonically_increasing_id()))
    keys = keys or choose_keys(tuples, sheet)
    if not keys:
        raise UsageError("no sheet column matches a row field")
    columns = [c for c in rows.columns if c != ORDER]
    names, used = {}, set(columns)
    for c in sheet.columns:
        if c != "__sheet" and c not in [k for k, _ in keys]:
            new = c if c not in used else next(n for i in range(1, 1000) if (n := f"{c}_sheet{'' if i == 1 else i}") not in used)
            names[c] = new
            used.add(new)
    hits = None
    for c, f in keys:
        left = tuples.select("__row", F.explode(row_keys(tuples, f)).alias("k"))
        raw = F.col(f"`{c}`").cast("string")
        exact = sheet.where(~S.holds(raw.rlike(r"[*?\[]"))).select("__sheet", sheet_key(F.col(f"`{c}`"), f).alias("k"))
        h = left.join(sized(exact), "k").select("__row", "__sheet")
        globs = sheet.where(raw.rlike(r"[*?\[]")).select("__sheet", F.lower(raw).alias("g")).toLocalIterator()
        for some in iter(lambda: list(islice(globs, GLOBS)), []):  # a predicate for each over the distinct names, so many at a time: no pairs
            found = F.array(*(F.when(F.col("k").rlike(fnmatch.translate(g).replace(r"\z", r"\Z")), F.lit(s)) for s, g in some))
            named = left.select("k").distinct().select("k", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("__sheet"))
            h = h.unionByName(left.join(named, "k").select("__row", "__sheet"))
        h = h.distinct()
        hits = h if hits is None else hits.join(h, ["__row", "__sheet"])
    annotations = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items())) if names else F.struct(F.lit(True).alias("__matched"))
    tagged = hits.join(sized(sheet.select("__sheet", annotations.alias("a"))), "__sheet")
    per = tagged.groupBy("__row").agg(F.count_distinct(F.to_json("a", {"ignoreNullFields": "false"})).alias("__n"), F.min_by("a", "__sheet").alias("__a"))
    found = tuples.join(per, "__row").select("__n", "__a", WEIGHT, *(F.col(f"`{c}`").alias(f"__on{i}") for i, c in enumerate(on)))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__on{i}"))
    joined = rows.join(found.drop(WEIGHT), same, "left")
    out = joined.select(*(F.col(f"`{c}`") for c in columns), *(F.when(F.col("__n") == 1, F.col(f"__a.{n}")).alias(n) for n in names.values()))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col(WEIGHT))), F.lit(0))
    counts = found.agg(total(F.col("__n") == 1).alias("one"), total(F.col("__n") > 1).alias("more")).first()
    left = rows.join(found.drop(WEIGHT), same, "left_anti").drop(ORDER)
    return out, Report(keys, counts["one"], counts["more"], left, sheet.join(hits, "__sheet", "left_anti").drop("__sheet"))


def layout_join(reads: DataFrame, *layouts: DataFrame) -> DataFrame:
    """Plate reads with role, sample, concentration ... by well; a later layout overrides an earlier one."""
    out = reads.withColumn("well", S.well(F.col("well")))
    for k, lay in enumerate(layouts):
        lay = lay.withColumn("well", S.well(F.col("well")))
        add = [c for c in lay.columns if c != "well"]
        side = lay.select("well", *(F.col(c).alias(f"__{k}{c}") for c in add))
        out = out.join(sized(side), "well", "left")
        out = out.select(*[c for c in out.columns if not c.startswith("__") and c not in add], *(F.coalesce(F.col(f"__{k}{c}"), F.col(c)).alias(c) if c in out.columns else F.col(f"__{k}{c}").alias(c) for c in add))
    return out


def grid_to_wells(grid: DataFrame, name: str) -> DataFrame:
    """A plate map (first column row letters, then column numbers) as well and annotation."""
    first, *numbers = grid.columns
    long = grid.select(F.col(f"`{first}`").alias("r"), *(F.col(f"`{c}`").cast("string").alias(c) for c in numbers)).unpivot("r", numbers, "c", name)
    return long.select(S.well(F.concat("r", "c")).alias("well"), name).where(F.col("well").isNotNull() & (F.trim(F.col(name)) != ""))


def band_join(points: DataFrame, bands: DataFrame, on: str, lo: str, hi: str, width: float, key: list[str] | None = None) -> DataFrame:
    """Points inside [lo, hi] of a band: bands are cut into buckets of `width`, so it is an equi-join with a residual."""
    key = key or []
    p = points.withColumn("__b", F.floor(F.col(on) / width))
    b = bands.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(b, [*key, "__b"]).where(F.col(on).between(F.col(lo), F.col(hi))).drop("__b")


def within(a: DataFrame, b: DataFrame, on: str, tolerance: float, key: list[str]) -> DataFrame:
    """Pairs of equal keys whose `on` differs by at most tolerance; b's columns end in _2."""
    right = b.select(*key, *(F.col(c).alias(f"{c}_2") for c in b.columns if c not in key))
    right = right.withColumn("__b", F.explode(F.array(*(F.floor(F.col(f"{on}_2") / tolerance) + k for k in (-1, 0, 1)))))
    left = a.withColumn("__b", F.floor(F.col(on) / tolerance))
    return left.join(right, [*key, "__b"]).where(F.abs(F.col(on) - F.col(f"{on}_2")) <= tolerance).drop("__b")
