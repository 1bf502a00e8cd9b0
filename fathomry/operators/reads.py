"""Statistics of sequencing reads (id, sequence, quality): expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scores(quality: Column) -> Column:
    """Phred scores of a quality text (offset 33)."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def mean_quality(quality: Column) -> Column:
    """The Phred score of the mean error probability."""
    q = scores(quality)
    mean = F.try_divide(F.aggregate(q, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), -x / 10)), F.size(q))
    return F.when(F.size(q) > 0, -10 * F.log10(mean))


def gc_percent(sequence: Column) -> Column:
    s = F.upper(sequence)
    gc, known = F.regexp_count(s, F.lit("[GC]")), F.regexp_count(s, F.lit("[ACGT]"))
    return F.try_divide(gc * 100.0, known)


def summary(reads: DataFrame, keys: list[str]) -> DataFrame:
    """reads, bases, shortest, longest, mean length, shares of bases of Q20 and Q30, gc, n."""
    q, s = scores(F.col("quality")), F.upper("sequence")
    r = reads.select(*keys, F.length("sequence").alias("len"), F.size(F.filter(q, lambda x: x >= 20)).alias("q20"), F.size(F.filter(q, lambda x: x >= 30)).alias("q30"), F.regexp_count(s, F.lit("[GC]")).alias("gc"), F.regexp_count(s, F.lit("[ACGT]")).alias("acgt"), F.regexp_count(s, F.lit("N")).alias("nn"))
    pct = lambda a, b: F.try_divide(F.sum(a) * 100.0, F.sum(b))
    return r.groupBy(*keys).agg(F.count("*").alias("reads"), F.sum("len").alias("bases"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.avg("len").alias("mean_length"), pct("q20", "len").alias("q20_percent"), pct("q30", "len").alias("q30_percent"), pct("gc", "acgt").alias("gc_percent"), pct("nn", "len").alias("n_percent"))


def per_position(reads: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Mean score and count at each position, or at each of the first `most`."""
    q = scores(F.col("quality"))
    p = reads.select(*keys, F.posexplode(q if most is None else F.slice(q, 1, most)).alias("position", "q"))
    return p.groupBy(*keys, "position").agg(F.avg("q").alias("mean"), F.count("*").alias("n"))


def composition(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of A, C, G, T and N."""
    s = F.upper("sequence")
    return reads.groupBy(*keys).agg(*(F.sum(F.regexp_count(s, F.lit(b))).alias(b.lower()) for b in "ACGTN"))
