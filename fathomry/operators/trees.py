"""Paths as trees: which data set owns a file, the nearest claim above a path, fingerprints of folders.

Files of a folder share its answer, so folders are told apart first and exploded to their ancestors, a row for each; what is claimed is
joined by equality. Sums over all files below a folder are partial aggregates, never lists.

Defined results: paths are parts between slashes; repeated slashes and one at the end don't count; a null path has no answer; a claim on a
file's own path counts for that file alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(path: Column) -> Column:
    """The path without empty parts: one slash before each."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(path.isNotNull(), F.concat(F.lit("/"), F.array_join(parts, "/")))


def ancestors(path: Column) -> Column:
    """The folders above a plain path and the path itself, from the root down."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(path.isNotNull(), upto)


def folder(path: Column) -> Column:
    """The folder of a plain path; the root is its own."""
    return F.when(path.isNotNull(), F.regexp_replace(F.regexp_replace(path, "/[^/]*$", ""), "^$", "/"))


def _answers(files: DataFrame, claims: DataFrame, path: str, pick) -> DataFrame:
    """files with what ``pick`` makes of the claims on and above each path."""
    f = files.withColumn("__at", plain(F.col(path)))
    # a file that is claimed itself asks by itself, all others by their folder
    own = claims.select(F.col("__claim").alias("__own")).distinct()
    f = f.join(own, F.col("__at") == F.col("__own"), "left").withColumn("__ask", F.coalesce("__own", folder(F.col("__at")))).drop("__own")
    asked = f.select("__ask").where("__ask IS NOT NULL").distinct()
    up = asked.withColumn("__claim", F.explode(ancestors(F.col("__ask"))))
    found = up.join(claims, "__claim").groupBy("__ask").agg(pick)
    return f.join(found, "__ask", "left").drop("__ask", "__at")


def nearest(files: DataFrame, claims: DataFrame, path: str, claim: str, values: list[str]) -> DataFrame:
    """files with the values of the deepest claim on or above each path; of equal claims that of the smallest values."""
    c = claims.select(plain(F.col(claim)).alias("__claim"), F.struct(*values).alias("__v")).where("__claim IS NOT NULL")
    c = c.groupBy("__claim").agg(F.min("__v").alias("__v"))
    deepest = F.max_by("__v", F.length("__claim")).alias("__v")
    got = _answers(files, c, path, deepest)
    return got.select(*files.columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def owners(files: DataFrame, claims: DataFrame, path: str, name: str = "data_set") -> DataFrame:
    """files with the folder that is their data set, null if there is none; claims: path, definite.

    A walk goes down from the root and stops at the first claimed folder; into one that is claimed with less than certainty it
    goes on where folders below are claimed themselves.
    """
    c = claims.select(plain(F.col("path")).alias("__claim"), F.coalesce("definite", F.lit(False)).alias("definite")).where("__claim IS NOT NULL")
    c = c.groupBy("__claim").agg(F.bool_or("definite").alias("definite"))
    holding = c.select(F.explode(ancestors(folder(F.col("__claim")))).alias("__claim"), F.col("__claim").alias("__below")).where("__claim <> __below").select("__claim").distinct()
    stops = c.where("definite").select("__claim").unionByName(c.where("NOT definite").join(holding, "__claim", "left_anti").select("__claim"))
    got = _answers(files, stops, path, F.min_by("__claim", F.length("__claim")).alias("__first"))
    return got.select(*files.columns, F.col("__first").alias(name))


#: Words of 32 bits of a file's hash that are summed apart.
LANES = 8


def fingerprints(files: DataFrame, path: str, content: str, size: str) -> DataFrame:
    """Of each folder with files anywhere below: folder, files, bytes, fingerprint.

    The fingerprint hashes the sums of the hashes of what is below, each of the path within the folder, size and content hash: it is the same
    wherever the folder lies and in whatever order files come, and another one when a file is renamed, moved, changed or there twice.
    """
    f = files.select(plain(F.col(path)).alias("p"), F.col(size).cast("long").alias("s"), F.col(content).cast("string").alias("c")).where("p IS NOT NULL")
    up = f.withColumn("folder", F.explode(ancestors(folder(F.col("p")))))
    within = F.when(F.col("folder") == "/", F.col("p")).otherwise(F.expr("substring(p, length(folder) + 1)"))
    h = F.sha2(F.concat_ws("\0", within, F.coalesce(F.col("s").cast("string"), F.lit("")), F.coalesce("c", F.lit(""))), 256)
    up = up.withColumn("h", h)
    lanes = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"lane{i}") for i in range(LANES)]
    sums = up.groupBy("folder").agg(F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"), *lanes)
    return sums.select("folder", "files", "bytes", F.sha2(F.concat_ws(",", F.col("files").cast("string"), *(F.col(f"lane{i}").cast("string") for i in range(LANES))), 256).alias("fingerprint"))
