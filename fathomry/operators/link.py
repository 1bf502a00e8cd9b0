"""Links between data sets: one equi-join per kind of evidence, groups by components.

Shared values are grouped instead of paired: a value shared by many data sets gives a
star of edges to its first member, never all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import semantics as S
from .graph import connected_components

HIGH, MEDIUM, LOW = 3, 2, 1
#: Words that name controls, names too general to mean an acquisition, words that come with a counter.
CONTROLS = ["blank", "blanc", "qc", "pool", "pooled", "std", "standard", "wash", "solvent", "cal", "calibrant", "calibration", "sst", "control", "ctrl", "empty", "test", "sample"]
GENERIC = ["data", "sample", "samples", "test", "raw", "file", "files", "run", "runs", "export", "result", "results", "analysis", "acqdata", "untitled", "default", "image", "images"]
COUNTED = ["id", "sample", "run", "inj", "injection", "vial", "file", "test", "no"]


def weak_identifier(c: Column) -> Column:
    """Control words whatever their digits, general names, a word and a counter, wells and tray positions."""
    t = S.normal_text(c)
    letters = F.regexp_replace(t, "[^a-z]", "")
    part = F.exists(F.split(t, "[:_, /-]"), lambda x: S.well(x).isNotNull())
    position = (F.length(F.regexp_replace(t, "[^a-z0-9]", "")) <= 6) & part
    return letters.isin(CONTROLS) | t.isin(GENERIC) | t.rlike(rf"^({'|'.join(COUNTED)})[ _#.-]*[0-9]{{1,4}}$") | position


def shared_value(df: DataFrame, id_: str, value: Column, kind: str, confidence: int, max_shared: int = 12, names: bool = True) -> DataFrame:
    """Edges (a, b, kind, confidence) among rows of one value; weak where too many share it or, of names, it says little."""
    rows = df.select(F.col(id_).alias("id"), value.alias("v")).where("v is not null and v <> ''").distinct()
    groups = rows.groupBy("v").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    weak = (weak_identifier(F.col("v")) & F.lit(names)) | (F.col("n") > max_shared)
    return rows.join(groups, "v").where("id <> a").select("a", F.col("id").alias("b"), F.lit(kind).alias("kind"), F.when(weak, LOW).otherwise(confidence).alias("confidence"))


def same_time(df: DataFrame, id_: str, at: str, slack_s: float, key: list[str]) -> DataFrame:
    """Neighbours in time within slack, whole hours apart included: chains of the next one within an hour's phase."""
    t = (F.col(at).cast("timestamp") if df.schema[at].dataType.simpleString().startswith("timestamp") else F.col(at)).cast("double")
    # days, and days from noon to noon: times up to 12 hours apart share one
    days = F.array(F.struct(F.lit(0).alias("of"), F.floor(t / 86_400).alias("n")), F.struct(F.lit(1).alias("of"), F.floor((t + 43_200) / 86_400).alias("n")))
    d = df.where(F.col(at).isNotNull()).select(F.col(id_).alias("id"), *key, F.pmod(t, F.lit(3600.0)).alias("p"), F.explode(days).alias("day"))
    wrap = d.unionByName(d.where(F.col("p") < slack_s).withColumn("p", F.col("p") + 3600))
    w = Window.partitionBy(*key, "day").orderBy("p", "id")
    n = wrap.withColumn("a", F.lag("id").over(w)).withColumn("gap", F.col("p") - F.lag("p").over(w))
    near = n.where((F.col("gap") <= slack_s) & (F.col("a") != F.col("id"))).select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    return near.select("a", "b", F.lit("same_acquisition").alias("kind"), F.lit(MEDIUM).alias("confidence"))


def token_contained(df: DataFrame, id_: str, sample: str, path: str) -> DataFrame:
    """A sample id that is a token of another data set's name: tokens are exploded, so it is an equi-join."""
    toks = df.select(F.col(id_).alias("b"), F.explode(F.array_distinct(F.split(F.lower(S.stem(F.col(path))), r"[^\p{L}\p{N}]+"))).alias("v")).where("length(v) >= 3")
    ids = df.select(F.col(id_).alias("a"), F.lower(F.trim(F.col(sample))).alias("v")).where("length(v) >= 3")
    strong = (F.length("v") >= 4) & F.col("v").rlike("[a-z]") & F.col("v").rlike("[0-9]")
    return ids.join(toks, "v").where("a <> b").select("a", "b", F.lit("sample_id_in_name").alias("kind"), F.when(strong, MEDIUM).otherwise(LOW).alias("confidence"))


def link(df: DataFrame, id_: str = "path", max_shared: int = 12) -> DataFrame:
    """All evidence that the table's columns allow."""
    kinds = [("sample_barcode", "same_barcode", HIGH, F.col), ("sample_id", "same_sample_id", HIGH, F.col), ("sample_name", "same_sample_name", MEDIUM, F.col), ("fingerprint", "conversion_source", HIGH, F.col)]
    edges = [shared_value(df, id_, S.normal_text(F.col(c)), k, conf, max_shared, c != "fingerprint") for c, k, conf, _ in kinds if c in df.columns]
    if "path" in df.columns:
        edges.append(shared_value(df, id_, F.when(F.length(S.stem(F.col("path"))) >= 3, F.lower(S.stem(F.col("path")))), "same_stem", MEDIUM, max_shared))
        if "sample_id" in df.columns:
            edges.append(token_contained(df, id_, "sample_id", "path"))
    if "started_at" in df.columns:
        edges.append(same_time(df, id_, "started_at", 1.0, [c for c in ("instrument_serial",) if c in df.columns]))
    return reduce(DataFrame.unionByName, edges)


def groups(edges: DataFrame, least: int = MEDIUM) -> DataFrame:
    """(id, component, confidence): confidence is the highest level at which the whole component stays together."""
    base = connected_components(edges.where(F.col("confidence") >= least))
    out = base.withColumn("confidence", F.lit(least))
    for level in range(least + 1, HIGH + 1):
        finer = connected_components(edges.where(F.col("confidence") >= level)).withColumnRenamed("component", "fine")
        whole = base.join(finer, "id", "left").groupBy("component").agg((F.bool_and(F.col("fine").isNotNull()) & (F.count_distinct("fine") == 1)).alias("whole"))
        out = out.join(whole, "component").withColumn("confidence", F.when(F.col("whole"), level).otherwise(F.col("confidence"))).drop("whole")
    return out
