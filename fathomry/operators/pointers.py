"""JSON values by pointer, on Spark's VARIANT: projection with wildcards, and the differences of nested documents.

A pointer is ``/images/0/size_x`` (``~1`` is a slash, ``~0`` a tilde); a number names an element of an array or a member
of an object, ``*`` each of them. Documents are parsed once and taken apart level by level, only where both sides are containers
of one kind, so a level's rows are the members still to be compared; those of a pair are paired within its row.

Defined results: text that is no JSON is no document; numbers are equal if their texts are or they differ by less than 1e-9 of the
larger; members of an object are unordered; where one side has nothing, the other's whole value is one difference.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UsageError
from .graph import checkpointed

#: At most so many pointers in a projection.
MAX_POINTERS = 64


def segments(pointer: str) -> list[str]:
    """The unescaped parts of a pointer; a leading # is left out."""
    body = pointer.strip().removeprefix("#").removeprefix("/")
    if not body:
        return []
    parts = [p.replace("~1", "/").replace("~0", "~") for p in body.split("/")]
    if "" in parts:
        raise UsageError(f"empty segment in {pointer!r}", "write pointers as /images/0/size_x")
    return parts


def _step(v: Column, part: str) -> Column:
    """The member of v that a part names, null if there is none."""
    if "'" in part and '"' in part:
        raise UsageError(f"no path for a name with both quotes: {part}")
    quote = '"' if "'" in part else "'"
    named = F.try_variant_get(v, f"$[{quote}{part}{quote}]", "variant")
    return F.coalesce(F.try_variant_get(v, f"$[{part}]", "variant"), named) if re.fullmatch(r"\d{1,9}", part) else named


def _kind(text: Column) -> Column:
    """object, array, number or other, by the JSON text of a value."""
    first = F.substring(text, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first.rlike("[-0-9]"), "number").when(text.isNotNull(), "other")


def resolve(v: Column, parts: list[str]) -> Column:
    """The JSON text of what the parts lead to from the variant v; null if they lead nowhere."""
    if not parts:
        return F.to_json(v)
    if parts[0] != "*":
        return resolve(_step(v, parts[0]), parts[1:])
    array, members = F.try_variant_get(v, "$", "array<variant>"), F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    each = F.transform(F.coalesce(array, members), lambda x: F.coalesce(resolve(x, parts[1:]), F.lit("null")))
    return F.when(F.coalesce(array, members).isNotNull(), F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")))


def pick(df: DataFrame, json: str, pointers: list[str]) -> DataFrame:
    """df with ``picked`` (JSON text by pointer, null where it leads nowhere) and ``missing`` (those pointers, in order)."""
    if len(pointers) > MAX_POINTERS:
        raise UsageError(f"at most {MAX_POINTERS} pointers, {len(pointers)} given")
    v = F.try_parse_json(json)
    found = [(p, resolve(F.col("__v"), segments(p))) for p in dict.fromkeys(pointers)]
    picked = F.create_map(*(x for p, c in found for x in (F.lit(p), c)))
    missing = F.filter(F.array(*(F.when(c.isNull(), F.lit(p)) for p, c in found)), lambda x: x.isNotNull())
    return df.withColumn("__v", v).withColumns({"picked": picked, "missing": missing}).drop("__v")


def _ignored(pointer: Column, patterns: list[str], extra: bool) -> Column:
    out = F.lit(False) if extra else pointer.rlike("/extra$")
    for p in patterns:
        body = "".join("/[^/]*" if x == "*" else "/" + re.escape(x.replace("~", "~0").replace("/", "~1")) for x in segments(p))
        out = out | pointer.rlike(f"^{body}$")
    return out


def _members(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, pointer, a, b of the members of two objects, or of two arrays; they are paired where they lie, without a shuffle."""
    objects, arrays = ([F.try_variant_get(s, "$", kind) for s in "ab"] for kind in ("map<string,variant>", "array<variant>"))
    named = F.map_entries(F.map_zip_with(*objects, lambda _, x, y: F.struct(x.alias("a"), y.alias("b"))))
    escaped = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    one = lambda name, x: F.struct(name.alias("name"), x["a"].alias("a"), x["b"].alias("b"))
    numbered = F.arrays_zip(*(c.alias(s) for c, s in zip(arrays, "ab", strict=True)))
    members = F.coalesce(F.transform(named, lambda e: one(escaped(e["key"]), e["value"])), F.transform(numbered, lambda x, i: one(i.cast("string"), x)))
    each = pairs.select(*key, "pointer", F.explode(members).alias("m"))
    return each.select(*key, F.concat("pointer", F.lit("/"), F.col("m.name")).alias("pointer"), F.col("m.a").alias("a"), F.col("m.b").alias("b"))


def diff(ours: DataFrame, theirs: DataFrame, key: list[str], json: str, ignore: list[str] | None = None, extra: bool = False, depth: int = 64) -> DataFrame:
    """key, pointer, ours, theirs (JSON texts) of every difference between the documents of equal keys, which are unique.

    ignore: pointers, with ``*`` for any part, that are left out with all below; so are members called ``extra``, unless asked for.
    """
    a, b = (d.select(*key, F.try_parse_json(json).alias(side)) for d, side in ((ours, "a"), (theirs, "b")))
    pairs = a.join(b, key, "full").withColumn("pointer", F.lit(""))
    found: DataFrame | None = None
    for _ in range(depth):
        texts = pairs.withColumns({"ta": F.to_json("a"), "tb": F.to_json("b")})
        kinds = texts.withColumns({"ka": _kind(F.col("ta")), "kb": _kind(F.col("tb"))})
        x, y = (F.try_variant_get(F.col(s), "$", "double") for s in "ab")
        close = F.when((F.col("ka") == "number") & (F.col("kb") == "number"), F.abs(x - y) <= 1e-9 * F.greatest(F.abs(x), F.abs(y)))
        inside = (F.col("ka") == F.col("kb")) & F.col("ka").isin("object", "array")
        differ = kinds.where(~F.col("ta").eqNullSafe(F.col("tb"))).where(~F.coalesce(close, F.lit(False))).withColumn("inside", F.coalesce(inside, F.lit(False)))
        # containers are kept as such, other values as their texts
        level = checkpointed(differ.select(*key, "pointer", "inside", *(F.when(F.col("inside"), F.col(c)).alias(c) for c in "ab"), *(F.when(~F.col("inside"), F.col(c)).alias(c) for c in ("ta", "tb"))))
        here = level.where("NOT inside").select(*key, "pointer", F.col("ta").alias("ours"), F.col("tb").alias("theirs"))
        found = here if found is None else found.unionByName(here)
        more = level.where("inside")
        if not more.limit(1).count():
            return found
        pairs = _members(more, key).where(~_ignored(F.col("pointer"), ignore or [], extra))
    raise UsageError(f"documents are nested deeper than {depth}")
