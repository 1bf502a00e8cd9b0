import pytest
from pyspark.sql import functions as F

from fathomry.errors import EngineError, UsageError
from fathomry.operators import catalog, plots, reads, tables
from fathomry.plans import batch


def test_groups_and_gates(spark):
    files = spark.createDataFrame([("a", True, 1, 10), ("b", False, 2, 20), ("c", True, 3, 30)], "path string, ok boolean, seq int, size_bytes long")
    claims = spark.createDataFrame([("a", "b")], "path string, member string")
    out = {r["component"]: (r["primary"], r["files"], r["size_bytes"]) for r in catalog.grouped_files(claims, files).collect()}
    assert out == {"a": ("a", 2, 30), "c": ("c", 1, 30)}
    df = spark.createDataFrame([("validated",), (None,)], "assurance string")
    with pytest.raises(EngineError):
        catalog.strict(df)
    assert catalog.strict(df.limit(1)).count() == 1
    assert [r[0] for r in spark.createDataFrame([("TIFF",), ("zvi",), ("czi",), (None,)], "f string").select(catalog.preservation(F.col("f"))).collect()] == ["open", "legacy", "vendor", None]


def test_reads(spark):
    df = spark.createDataFrame([("ACGN", "II5!"), ("", "")], "sequence string, quality string")
    s = reads.summary(df, []).first()
    assert (s["reads"], s["bases"], s["shortest"]) == (2, 4, 0) and s["q30_percent"] == 50.0 and s["n_percent"] == 25.0
    q = [r[0] for r in df.select(reads.mean_quality(F.col("quality"))).collect()]
    assert abs(q[0] - 5.98) < 0.02 and q[1] is None
    assert reads.per_position(df, []).count() == 4 and reads.composition(df, []).first()["g"] == 1


def test_compare_tolerance_and_missing_rows(spark):
    a = spark.createDataFrame([(1, "1.0", "x"), (2, "2", None)], "k int, v string, t string")
    b = spark.createDataFrame([(1, "1.0000001", "x"), (3, "5", None)], "k int, v string, t string")
    out = sorted((r["k"], r["column"]) for r in catalog.compare(a, b, ["k"], 1e-3).collect())
    assert out == [(2, "v"), (3, "v")]


def test_plots(spark):
    assert plots.preview_bins(10_000, 30) == 28 or 24 <= plots.preview_bins(10_000, 30) <= 160
    df = spark.createDataFrame([], "k string, x double, y double")
    assert plots.density(df, ["k"], "x", "y").count() == 0


def test_measures_and_batch(spark, tmp_path):
    df = spark.createDataFrame([("p/a.abf", 0, 1.0), ("p/a.abf", 1, float("nan")), ("p/b.abf", 0, 5.0)], "path string, t int, value double")
    out = batch.run_measure("trace", df, keys=["path"])
    assert {r["path"]: r["finite"] for r in out.collect()} == {"p/a.abf": 1, "p/b.abf": 1}
    with pytest.raises(UsageError):
        batch.run_measure("trace", df, keys=["path"], wrong=1)
    with pytest.raises(UsageError):
        batch.analyze("nothing", df)
    sheet = spark.createDataFrame([("a", "ctrl"), ("b", "drug")], "name string, condition string")
    b = batch.Batch(df, "trace", {"keys": ["path"]}, sheet, where=["condition!=ctrl"], fields=["condition", "mean"])
    assert [tuple(r) for r in b.run().collect()] == [("p/b.abf", "drug", 5.0)] and b.report.keys == [("name", "stem")]
    b.save(str(tmp_path / "o.parquet"))
    assert tables.union(df, df).count() == 3
