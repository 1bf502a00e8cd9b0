"""Table files in and out: typed reads, sample sheets, verified writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptInput, UsageError
from ..operators.tables import typed

SEPARATORS = {"csv": ",", "tsv": "\t", "txt": "\t"}


def _kind(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in (*SEPARATORS, "json", "jsonl", "ndjson", "parquet"):
        raise UsageError(f"no table format for .{ext}", "csv, tsv, json, jsonl or parquet")
    return ext


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its extension; text columns are typed from all their cells."""
    kind = _kind(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in SEPARATORS:
        return typed(spark.read.option("header", True).option("sep", SEPARATORS[kind]).option("escape", '"').option("multiLine", True).csv(path))
    return spark.read.option("multiLine", kind == "json").option("primitivesAsString", False).json(path)


def sniff_separator(line: str) -> str:
    return max(",;\t", key=line.count)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sample sheet: separator from the first line, repeated headers numbered, cells trimmed, empty ones null."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise CorruptInput(f"empty sheet {path}")
    raw = spark.read.option("header", False).option("sep", sniff_separator(head[0][0])).option("multiLine", True).option("escape", '"').csv(path)
    first = raw.limit(1).collect()[0]
    names, seen = [], {}
    for i, c in enumerate(first):
        base = (c or f"column{i + 1}").strip().lstrip("﻿")
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    same = F.lit(True)
    for c, v in zip(raw.columns, first, strict=True):
        same = same & F.col(c).eqNullSafe(F.lit(v))
    body = raw.where(~same).toDF(*names)
    return typed(body.select(*(F.when(F.trim(F.col(f"`{n}`")) != "", F.trim(F.col(f"`{n}`"))).alias(n) for n in names)))


def digest(df: DataFrame) -> dict[str, int]:
    """Rows, and for every column an order-free hash of its cells."""
    cells = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(i), F.col(f"`{c}`").cast("string"))), F.lit(0)).alias(c) for i, c in enumerate(df.columns)]
    sums = [F.coalesce(F.sum(F.pmod(F.xxhash64(F.col(f"`{c}`").cast("string")), F.lit(1_000_003))), F.lit(0)).alias(f"{c}\0") for c in df.columns]
    return df.agg(F.count("*").alias("\0rows"), *cells, *sums).first().asDict()


def save_table(df: DataFrame, path: str, *, overwrite: bool = False, verify: bool = True) -> None:
    """Written by its extension, never over a table unless asked, read back and compared."""
    kind = _kind(path)
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if kind in SEPARATORS:
        w.option("header", True).option("sep", SEPARATORS[kind]).option("escape", '"').csv(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        w.option("ignoreNullFields", False).json(path)
    if verify:
        spark = df.sparkSession
        back = spark.read.parquet(path) if kind == "parquet" else spark.read.schema(df.schema).option("header", True).option("sep", SEPARATORS.get(kind, ",")).option("escape", '"').option("multiLine", True).csv(path) if kind in SEPARATORS else spark.read.schema(df.schema).json(path)
        if digest(back) != digest(df):
            raise CorruptInput(f"{path} does not read back as written")


def crawl(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, mtime, name, ext of all files under root, hidden ones left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).drop("content")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("ext")).where(~name.startswith("."))


def changes(now: DataFrame, before: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """path and change (new, changed, same, gone, moved) of a crawl against the last: one full join."""
    a = now.select("path", F.struct(*[c for c in now.columns if c != "path"]).alias("n"))
    b = before.select("path", F.struct(*[c for c in before.columns if c != "path"]).alias("o"))
    same = (F.col("n.size_bytes") == F.col("o.size_bytes")) & (F.col("n.mtime") == F.col("o.mtime"))
    out = a.join(b, "path", "full").withColumn("change", F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(same, "same").otherwise("changed"))
    if not fingerprint:
        return out.select("path", "change", F.lit(None).cast("string").alias("moved_from"))
    fresh = out.where("change = 'new'").select(F.col("path").alias("to"), F.col(f"n.{fingerprint}").alias("f"), F.col("n.size_bytes").alias("s"))
    left = out.where("change = 'gone'").select(F.col("path").alias("moved_from"), F.col(f"o.{fingerprint}").alias("f"), F.col("o.size_bytes").alias("s"))
    moved = fresh.join(left, ["f", "s"]).groupBy(F.col("to").alias("path")).agg(F.min("moved_from").alias("moved_from"))
    res = out.join(moved, "path", "left")
    return res.select("path", F.when(F.col("moved_from").isNotNull(), "moved").otherwise(F.col("change")).alias("change"), "moved_from")


#: First bytes that tell formats.
MAGIC = {"tiff": [b"II*\x00", b"MM\x00*", b"II+\x00"], "fcs": [b"FCS"], "hdf5": [b"\x89HDF"], "zip": [b"PK\x03\x04"], "abf": [b"ABF"], "czi": [b"ZISRAWFILE"], "png": [b"\x89PNG"], "jpeg": [b"\xff\xd8\xff"], "parquet": [b"PAR1"], "gzip": [b"\x1f\x8b"], "xml": [b"<?xml"]}


def sniff(content, size: int = 16):
    """The format of a binary column by its first bytes, as an expression."""
    head = F.substring(content, 1, size)
    out = F.lit(None).cast("string")
    for name, marks in MAGIC.items():
        for m in marks:
            out = F.when(F.substring(head, 1, len(m)) == F.lit(m), name).otherwise(out)
    return out
