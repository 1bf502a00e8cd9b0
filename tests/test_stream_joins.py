import random
from datetime import datetime, timedelta

from fathomry.streaming.joins import dropped, interval_join

BASE = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, at timestamp, a int", "k string, seen timestamp, b int"


def rows(seed, n, name):
    r = random.Random(seed)
    return [(r.choice(["x", "y", "hot", "hot", "hot", None]), BASE + timedelta(seconds=r.randint(0, 3000)), i) for i in range(n)]


def pairs(left, right, before, after):
    out = []
    for k, at, a in left:
        hits = [b for j, seen, b in right if j is not None and j == k and -before <= (seen - at).total_seconds() <= after]
        out += [(a, b) for b in hits] or [(a, None)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["a"], r["b"]) for r in df.collect()), key=str)


def test_batch_like_all_pairs(spark):
    left, right = rows(1, 150, "a"), rows(2, 150, "b")
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    for before, after in [(60, 0), (0, 0), (90, 45), (0, 300)]:
        want = pairs(left, right, before, after)
        assert got(interval_join(a, b, ["k"], "at", "seen", before, after, how="left_outer")) == want
        assert got(interval_join(a, b, ["k"], "at", "seen", before, after)) == [p for p in want if p[1] is not None]
    assert interval_join(a.limit(0), b, ["k"], "at", "seen", 5, 5, how="left_outer").count() == 0


def test_stream_like_batch_and_late_rows(spark, tmp_path):
    """In three runs on one checkpoint, in order of time; unmatched rows come when the watermark has passed; late rows are counted."""
    left, right = ([x for x in rows(s, 90, "") if x[0]] for s in (3, 4))
    a_in, b_in, out = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "out")
    end = BASE + timedelta(days=2)
    late = ("x", BASE - timedelta(days=1), 7777)
    n = 0
    for lo, hi in [(0, 1500), (1500, 9999), (None, None), (None, None)]:
        for data, ddl, src in ((left, LEFT, a_in), (right, RIGHT, b_in)):
            some = [x for x in data if lo is not None and lo <= (x[1] - BASE).total_seconds() < hi] or [("end", end + timedelta(hours=n), -1), *([late] if n > 2 else [])]
            spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(src)
        n += 1
        streams = [spark.readStream.schema(ddl).parquet(src) for ddl, src in ((LEFT, a_in), (RIGHT, b_in))]
        q = interval_join(*streams, ["k"], "at", "seen", 60, 30, "1 second", "left_outer").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    assert dropped(q) > 0
    assert got(spark.read.parquet(out).where("k <> 'end'")) == pairs(left, right, 60, 30)
