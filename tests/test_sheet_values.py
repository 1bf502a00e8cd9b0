from collections import Counter

from fathomry.operators import joins

DDL = "path string, started_at string, sample_id string, v int"


def test_rows_of_equal_keys_match_once_and_all_get_it(spark):
    rows = spark.createDataFrame([(f"/d/{'ab'[i % 2]}.fcs", None, "S1" if i % 3 else None, i) for i in range(30)], DDL)
    sheet = spark.createDataFrame([("a.fcs", "x"), ("c.fcs", "z")], "file string, tag string")
    out, rep = joins.sheet_join(rows, sheet)
    assert Counter((r["v"] % 2, r["tag"]) for r in out.collect()) == {(0, "x"): 15, (1, None): 15}
    assert (rep.matched, rep.ambiguous, rep.unmatched_rows.count(), rep.unmatched_sheet.count()) == (15, 0, 15, 1)
    assert out.columns == [*rows.columns, "tag"] and rep.unmatched_rows.columns == rows.columns
    assert "Python" not in out._jdf.queryExecution().toString()


def test_ambiguous_rows_and_null_keys(spark):
    rows = spark.createDataFrame([("/p", None, "s1", 1), ("/p", None, "s1", 1), ("/q", None, None, 2), ("/r", None, "s2", 3)], DDL)
    sheet = spark.createDataFrame([("S1", "x"), ("s1 ", "y"), ("s2", "w"), ("s2", "w")], "sample string, tag string")
    out, rep = joins.sheet_join(rows, sheet, [("sample", "sample_id")])
    assert sorted((r["v"], r["tag"]) for r in out.collect() if r["tag"]) == [(3, "w")] and out.count() == 4
    assert (rep.matched, rep.ambiguous, rep.unmatched_rows.count(), rep.unmatched_sheet.count()) == (1, 2, 1, 0)


def test_run_order_goes_by_start(spark):
    rows = spark.createDataFrame([(f"/f{i}", f"2024-01-{31 - i:02d}", None, i) for i in range(12)] + [("/late", None, None, 99)], DDL).repartition(4)
    sheet = spark.createDataFrame([(i + 1, f"t{i + 1}") for i in range(12)] + [(40, "none")], "injection int, tag string")
    out, rep = joins.sheet_join(rows, sheet, [("injection", "run_order")])
    assert {r["v"]: r["tag"] for r in out.collect()} == {11 - i: f"t{i + 1}" for i in range(12)} | {99: None}
    assert joins.ORDER not in out.columns and joins.ORDER not in rep.unmatched_rows.columns and rep.unmatched_sheet.count() == 1


def test_the_better_key_counts_rows_not_values(spark):
    """One value of many rows weighs more than several of one row each."""
    rows = spark.createDataFrame([("/many.raw", None, None, i) for i in range(9)] + [(f"/o{i}", None, f"s{i}", i) for i in range(4)], DDL)
    sheet = spark.createDataFrame([("many.raw", "zz", "x"), ("none", "s1", "y"), ("nil", "s2", "z"), ("no", "s3", "w")], "file string, sample string, tag string")
    _, rep = joins.sheet_join(rows, sheet)
    assert rep.keys[0] == ("file", "file") or rep.keys[0][0] == "file"
    assert rep.matched == 9
    empty, rep = joins.sheet_join(rows.limit(0), sheet, [("file", "file")])
    assert empty.count() == 0 and rep.matched == 0
