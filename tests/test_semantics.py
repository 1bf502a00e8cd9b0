import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomry import semantics as S
from fathomry.errors import UsageError
from fathomry.functions import special, units
from fathomry.operators import search, tables


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_numbers_and_finite(spark):
    assert values(spark, [("1",), (" -2.5e3 ",), ("1,000",), ("nan",), (None,), ("",)], "a string", S.number(F.col("a"))) == [1.0, -2500.0, None, None, None, None]
    assert values(spark, [(float("nan"),), (float("inf"),), (2.0,), (None,)], "a double", S.finite(F.col("a"))) == [None, None, 2.0, None]


def test_wells_and_natural_order(spark):
    assert values(spark, [("A1",), ("a01",), ("A-1",), ("R1C1",), ("AF48",), ("Z99",), ("hello",), (None,)], "a string", S.well(F.col("a"))) == ["A01", "A01", "A01", "A01", "AF48", None, None, None]
    df = spark.createDataFrame([("donor 10",), ("Donor 2",), ("donor 02b",), (None,)], "a string")
    assert [r[0] for r in df.orderBy(S.natural_key(F.col("a")).asc_nulls_last(), "a").collect()] == ["Donor 2", "donor 02b", "donor 10", None]


def test_tidy_filter_keeps_null_on_negation(spark):
    df = spark.createDataFrame([("Ctrl", 1.0), ("b", 2.0), (None, None)], "c string, v double")
    assert tables.tidy_filter(df, "c=ctrl").count() == 1
    assert tables.tidy_filter(df, "c!=ctrl").count() == 2
    assert tables.tidy_filter(df, "c=").count() == 1 and tables.tidy_filter(df, "v!=1", "c!=").count() == 1
    with pytest.raises(UsageError):
        tables.tidy_filter(df, "x=1")


def test_row_filter_fails_on_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,), (None,)], "v double")
    assert tables.count_rows(df, "v != 1").first()["matched"] == 1
    assert tables.count_rows(df.limit(0), "v > 1").first()["percent"] is None


def test_typing(spark):
    df = spark.createDataFrame([("1", "x", "1.5", "true", ""), ("2", "3", None, "FALSE", None)], "a string, b string, c string, d string, e string")
    out = tables.typed(df)
    assert dict(out.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "boolean", "e": "string"}


def test_quantities_and_dates():
    assert units.quantity("63x", "magnification") == 63 and units.quantity("1.5GB", "bytes") == 1.5e9 and units.quantity("10 min", "seconds") == 600 and units.quantity("5kg", "bytes") is None
    assert units.date_range("2024-12") == (dt.datetime(2024, 12, 1), dt.datetime(2025, 1, 1))
    assert units.date_range("2024-02-30") is None and units.human_bytes(1_500_000) == "1.5 MB"


def test_query_language(spark):
    rows = [("a.czi", 2_000_000_000, "FBbi_00000246", ["DAPI", "GFP"], dt.datetime(2024, 5, 2), '{"Gain": {"value": 5}}', 63.0, "Plan"), ("b.fcs", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "path string, size_bytes long, technique_id string, channels array<string>, started_at timestamp_ntz, parameters_json string, objective_magnification double, objective string")
    hits = lambda q: [r["path"] for r in search.search(df, q).collect()]
    assert hits("size>1GB") == ["a.czi"] and hits("-size>1GB") == ["b.fcs"]
    assert hits("technique:FBBI:00000246") == ["a.czi"] and hits("channel:gfp|cy5") == ["a.czi"] and hits("channel!~gfp") == ["b.fcs"]
    assert hits("acquired=2024-05") == ["a.czi"] and hits("acquired>2024-05-02") == [] and hits("param.gain>=5") == ["a.czi"]
    assert hits("objective=63x") == ["a.czi"] and hits("czi OR fcs") == ["a.czi", "b.fcs"] and hits("'a.czi'") == ["a.czi"]
    for bad in ("size>1GB OR", "'x", "nofield=1", "acquired=soon"):
        with pytest.raises(UsageError):
            hits(bad)


def test_special_functions():
    assert abs(special.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(special.t_quantile(0.975, 10) - 2.2281389) < 1e-6
    assert abs(special.grubbs_critical(10) - 2.2899536) < 1e-4
    assert abs(special.mann_whitney_p(0, 3, 4, 0) - 2 / 35) < 1e-12
    assert special.mann_whitney_counts(2, 3).tolist() == [1, 1, 2, 2, 2, 1, 1]
    assert abs(special.normal_sf(1.96) - 0.0249979) < 1e-6


def test_as_of_and_nearest(spark):
    a = spark.createDataFrame([("k", 1.0), ("k", 5.0), ("j", 5.0)], "k string, t double")
    b = spark.createDataFrame([("k", 0.5, "x"), ("k", 5.0, "y")], "k string, t double, v string")
    assert sorted((r["k"], r["t"], r["v"]) for r in tables.as_of(a, b, ["k"], "t", ["v"]).collect()) == [("j", 5.0, None), ("k", 1.0, "x"), ("k", 5.0, "y")]
    assert tables.nearest(b, ["k"], "t", 2.0).first()["v"] == "x"


def test_long_digit_runs_keep_their_order(spark):
    names = [f"x{'9' * 25}", f"x1{'0' * 25}", f"x1{'0' * 24}1", "x7", "x07b"]
    df = spark.createDataFrame([(x,) for x in names], "a string")
    assert [r[0] for r in df.orderBy(S.natural_key(F.col("a")), "a").collect()] == ["x7", "x07b", f"x{'9' * 25}", f"x1{'0' * 25}", f"x1{'0' * 24}1"]
