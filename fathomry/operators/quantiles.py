"""Exact values at ranks, without a group's values in one buffer or one task.

A round counts, of the values that can still be at a rank, those below, within and above a narrow range that a bounded sketch gave; the part
with the rank goes on, and its sketch gives the next range. Counts and sketches are partial aggregates, so a group is never gathered before
less than ``small`` values are left. A round leaves about 4 in ``SPLITS`` of the values, or settles a value that is there very often; so a trillion
values take four or five. The input is read once a round: store it if it is costly.

Defined results: null and NaN values are left out; groups without values have no row; a null key is a group; ties are no matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from .graph import checkpointed

#: Parts that a sketch cuts a range into, and its accuracy: an error of less than a part.
SPLITS, ACCURACY = 256, 2000


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], small: int = 10_000, rounds: int = 40) -> DataFrame:
    """A row per group: keys, n (values), and per name the value at that rank, from 0; ranks are expressions over n."""
    d = df.select(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    g = [f"__g{i}" for i in range(len(keys))] or ["__one"]
    d = d if keys else d.withColumn("__one", F.lit(0))
    sizes = checkpointed(d.groupBy(*g).agg(F.count("*").alias("n")))
    wanted = F.array(*(F.struct(F.lit(name).alias("t"), F.least(F.greatest(r.cast("long"), F.lit(0)), F.col("n") - 1).alias("k")) for name, r in ranks.items()))
    # the values that are left are those above lo and below hi (null: all), or equal to them where lo_in and hi_in say so; a and b are the range to try
    left = sizes.select(*g, F.col("n").alias("m"), F.explode(wanted).alias("x")).select(*g, "m", "x.t", "x.k")
    left = left.select("*", *(F.lit(None).cast("double").alias(c) for c in ("lo", "hi", "a", "b")), *(F.lit(False).alias(c) for c in ("lo_in", "hi_in")))
    settled: list[DataFrame] = []
    names = [f"__k{i}" for i in range(len(g))]
    for _ in range(rounds):
        few = left.where(F.col("m") <= small)
        over = F.col("v") > F.col("lo")
        under = F.col("v") < F.col("hi")
        inside = (F.col("lo").isNull() | over | (F.col("lo_in") & (F.col("v") == F.col("lo")))) & (F.col("hi").isNull() | under | (F.col("hi_in") & (F.col("v") == F.col("hi"))))
        match = F.lit(True)
        for c, k in zip(g, names, strict=True):
            match = match & F.col(c).eqNullSafe(F.col(k))

        def meet(targets: DataFrame) -> DataFrame:
            return d.join(targets.withColumnsRenamed(dict(zip(g, names, strict=True))), match & inside).drop(*names)  # noqa: B023

        values = meet(few).groupBy(*g, "t").agg(F.element_at(F.array_sort(F.collect_list("v")), (F.first("k") + 1).cast("int")).alias("value"))
        settled.append(checkpointed(values))
        left = checkpointed(left.where(F.col("m") > small))
        if not left.limit(1).count():
            break
        a, b, v = F.coalesce("a", F.lit(float("-inf"))), F.coalesce("b", F.lit(float("inf"))), F.col("v")
        # the three parts of what is left, each with its count and sketch: only the one with the rank goes on
        part = F.when(v < a, 0).when(v <= b, 1).otherwise(2)
        cuts = [i / SPLITS for i in range(1, SPLITS)]
        parts = meet(left).groupBy(*g, "t", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", cuts, ACCURACY).alias("sketch"))
        each = parts.groupBy(*g, "t").agg(F.array_sort(F.collect_list(F.struct("part", "c", "least", "most", "sketch"))).alias("p"))
        both = left.select(*g, "t", "k").withColumnsRenamed(dict(zip([*g, "t"], [*names, "__t"], strict=True))).join(each, match & (F.col("t") == F.col("__t"))).drop(*names, "__t")
        before = F.expr("transform(sequence(1, size(p)), i -> aggregate(slice(p, 1, i - 1), 0L, (s, x) -> s + x.c))")
        both = both.withColumn("before", before).withColumn("at", F.expr("filter(sequence(1, size(p)), i -> k >= before[i - 1] AND k < before[i - 1] + p[i - 1].c)[0]"))
        both = both.select(*g, "t", (F.col("k") - F.expr("before[at - 1]")).alias("k"), F.expr("p[at - 1]").alias("x"))
        settled.append(checkpointed(both.where("x.least = x.most").select(*g, "t", F.col("x.least").alias("value"))))
        both = both.where("x.least < x.most").withColumn("s", F.expr("concat(array(x.least), x.sketch, array(x.most))"))
        both = both.withColumn("i", F.least(F.floor((F.col("k") + 0.5) / F.col("x.c") * SPLITS), F.lit(SPLITS - 1)).cast("int"))
        lower, upper = F.expr("s[greatest(i - 1, 0)]"), F.expr(f"s[least(i + 2, {SPLITS})]")
        # a range of everything would tell nothing: then the value in the middle is tried alone
        all_of_it = (lower <= F.col("x.least")) & (upper >= F.col("x.most"))
        left = checkpointed(
            both.select(*g, F.col("x.c").alias("m"), "t", "k", F.col("x.least").alias("lo"), F.col("x.most").alias("hi"), F.when(all_of_it, F.expr("s[i]")).otherwise(lower).alias("a"), F.when(all_of_it, F.expr("s[i]")).otherwise(upper).alias("b"), F.lit(True).alias("lo_in"), F.lit(True).alias("hi_in"))
        )
    else:
        raise EngineError(f"ranks are not settled in {rounds} rounds")
    found = settled[0]
    for s in settled[1:]:
        found = found.unionByName(s)
    wide = found.groupBy(*g).agg(*(F.max(F.when(F.col("t") == name, F.col("value"))).alias(name) for name in ranks))
    out = sizes.withColumnsRenamed(dict(zip(g, names, strict=True)))
    match = F.lit(True)
    for c, k in zip(g, names, strict=True):
        match = match & F.col(c).eqNullSafe(F.col(k))
    out = wide.join(out, match)
    return out.select(*(F.col(f"__g{i}").alias(k) for i, k in enumerate(keys)), "n", *ranks)


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], small: int = 10_000) -> DataFrame:
    """A row per group: keys, n, and per name the quantile, interpolated between the ranks around (n - 1) p."""
    ranks: dict[str, Column] = {}
    for name, p in probabilities.items():
        ranks[f"{name}__0"] = F.floor((F.col("n") - 1) * F.lit(p))
        ranks[f"{name}__1"] = F.ceil((F.col("n") - 1) * F.lit(p))
    got = at_ranks(df, keys, value, ranks, small)
    at = lambda name, p: F.col(f"{name}__0") + (F.col(f"{name}__1") - F.col(f"{name}__0")) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * F.lit(p)))
    same = lambda name, p: F.when(F.col(f"{name}__0") == F.col(f"{name}__1"), F.col(f"{name}__0")).otherwise(at(name, p))
    return got.select(*keys, "n", *(same(name, p).alias(name) for name, p in probabilities.items()))


def nearest_ranks(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], small: int = 10_000) -> DataFrame:
    """A row per group: keys, n, and per name the value at the rank nearest to (n - 1) p, the higher of two."""
    return at_ranks(df, keys, value, {name: F.floor((F.col("n") - 1) * F.lit(p) + 0.5) for name, p in probabilities.items()}, small)
