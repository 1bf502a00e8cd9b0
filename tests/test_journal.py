import pytest
from pyspark.sql import functions as F

from fathomry.errors import UsageError
from fathomry.sources import journal


def items(spark, n, size=lambda i: i, skip=()):
    rows = [(f"p{i:03d}", size(i), 1.0, i) for i in range(n) if i not in skip]
    return spark.createDataFrame([*rows, ("p001", 0, 0.5, 9), (None, 1, 1.0, 1)], "path string, size_bytes long, mtime double, place int")


def rows(job, spark):
    got = job.records(spark)
    return sorted((r["seq"], r["path"], r["size_bytes"], r["change"], r["read"]) for r in got.collect()) if got is not None else []


def test_caps_resume_and_reuse(spark, tmp_path):
    read = lambda d: d.withColumn("read", F.concat(F.lit("r"), F.col("size_bytes")))
    job = journal.Job(f"file://{tmp_path}/j", read, chunk_items=4)
    assert job.run(items(spark, 10), max_items=5) == journal.Progress(0, False, 8, 2)
    assert [r[1] for r in rows(job, spark)] == [f"p{i:03d}" for i in range(8)]
    assert job.run(items(spark, 10), max_seconds=0) == journal.Progress(0, True, 2, 1)
    want = [(i + 1, f"p{i:03d}", i, "new", f"r{i}") for i in range(10)]
    assert rows(job, spark) == want
    # a second run reads what is new or changed alone
    again = items(spark, 13, lambda i: i + 100 * (i % 5 == 0), skip=(3,))
    assert job.run(again, max_items=1) == journal.Progress(1, False, 4, 1)
    half = {r[1]: r for r in rows(job, spark)}
    assert half["p000"][3:] == ("changed", "r100") and half["p005"][3:] == ("changed", "r105") and half["p002"][3:] == ("same", "r2") and "p012" not in half and "p003" not in half
    assert job.run(again).finished
    got = {r[1]: r for r in rows(job, spark)}
    assert len(got) == 12 and got["p010"][3:] == ("new", "r110") and got["p012"][0] == 12
    other = journal.Job(f"file://{tmp_path}/j", read, {"check": "deep"}, 4)
    assert other.run(again).items == 12 and {r[3] for r in rows(other, spark)} == {"changed"}


def test_killed_between_write_and_journal(spark, tmp_path, monkeypatch):
    """The chunk that was written and not entered is read again, and comes once."""
    job = journal.Job(f"file://{tmp_path}/j", lambda d: d.withColumn("read", F.lit("x")), chunk_items=3)
    entry, calls = journal.Job._entry, []

    def dies(self, spark, run, chunk, n):
        calls.append(chunk)
        if chunk == 1:
            raise KeyboardInterrupt
        entry(self, spark, run, chunk, n)

    monkeypatch.setattr(journal.Job, "_entry", dies)
    with pytest.raises(KeyboardInterrupt):
        job.run(items(spark, 8))
    assert [r[1] for r in rows(job, spark)] == ["p000", "p001", "p002"]
    monkeypatch.setattr(journal.Job, "_entry", entry)
    with pytest.raises(UsageError):
        journal.Job(job.where, job.read, {"other": 1}, 3).run(items(spark, 8))
    assert job.run(items(spark, 8)) == journal.Progress(0, True, 5, 2)
    assert [r[:2] for r in rows(job, spark)] == [(i + 1, f"p{i:03d}") for i in range(8)]


def test_chunks_are_read_together(spark, tmp_path, monkeypatch):
    """Jobs don't grow with the chunks; a kill leaves none of those read together, caps and the next session hold to chunks."""
    reads = []
    job = journal.Job(f"file://{tmp_path}/j", lambda d: reads.append(1) or d.withColumn("read", F.lit("x")), chunk_items=2)
    entry, calls = journal.Job._entry, []

    def dies(self, spark, run, chunk, n):
        calls.append(chunk)
        if len(calls) == 2:
            raise KeyboardInterrupt
        entry(self, spark, run, chunk, n)

    monkeypatch.setattr(journal, "TOGETHER_S", 3600.0)
    monkeypatch.setattr(journal.Job, "_entry", dies)
    with pytest.raises(KeyboardInterrupt):
        job.run(items(spark, 81))
    assert calls == [0, 1] and len(reads) == 2 and [r[1] for r in rows(job, spark)] == ["p000", "p001"]
    assert job.run(items(spark, 81), max_items=7) == journal.Progress(0, False, 8, 4) and len(reads) == 3
    assert [r[1] for r in rows(job, spark)] == [f"p{i:03d}" for i in range(10)]
    assert job.run(items(spark, 81), max_seconds=0) == journal.Progress(0, False, 2, 1) and len(reads) == 4
    assert job.run(items(spark, 81)) == journal.Progress(0, True, 69, 35) and len(reads) == 5
    assert [r[:2] for r in rows(job, spark)] == [(i + 1, f"p{i:03d}") for i in range(81)]


def test_chunks_that_take_long_are_read_alone():
    left = [(i, 2) for i in range(5)]
    assert journal.Job._together(left, None, None, None) == (left[:1], left[1:])
    assert journal.Job._together(left, journal.TOGETHER_S, None, None) == (left[:1], left[1:])
    assert journal.Job._together(left, 1.0, None, 3.5) == (left[:3], left[3:]) and journal.Job._together(left, 0.0, 5, None) == (left[:3], left[3:])
    assert journal.Job._together(left, 1.0, 0, None) == (left[:1], left[1:]) and journal.Job._together(left, 0.0, None, None) == (left, [])


def test_journals_of_older_versions_go_on(spark, tmp_path):
    """Entries without seconds, a folder a chunk."""
    job = journal.Job(f"file://{tmp_path}/j", lambda d: d.withColumn("read", F.lit("x")), chunk_items=3)
    job.run(items(spark, 8), max_items=1)
    old = [(0, 3)]
    spark.createDataFrame(old, "chunk long, items long").coalesce(1).write.mode("overwrite").parquet(f"{job.where}/run=0/journal")
    assert job.run(items(spark, 8)) == journal.Progress(0, True, 5, 2)
    assert [r[:2] for r in rows(job, spark)] == [(i + 1, f"p{i:03d}") for i in range(8)]


def test_nothing_to_read(spark, tmp_path):
    job = journal.Job(f"file://{tmp_path}/j", lambda d: d.withColumn("read", F.lit("x")))
    assert job.run(items(spark, 8).limit(0)) == journal.Progress(0, True, 0, 0) and rows(job, spark) == []
    assert job.run(items(spark, 2)).items == 2


def test_a_batch_is_written_once(spark, tmp_path):
    """A batch that failed after its write is done again over its own folder."""
    src, where = str(tmp_path / "in"), f"file://{tmp_path}/log"
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("k string, n int").parquet(src)
    journal.write_once(stream(), where, availableNow=True).awaitTermination(120)
    # the commit of the batch is lost, as if the driver had died before it
    for f in (tmp_path / "log/checkpoint/commits").iterdir():
        f.unlink()
    journal.write_once(stream(), where, availableNow=True).awaitTermination(120)
    spark.createDataFrame([("c", 0)], "k string, n int").coalesce(1).write.mode("append").parquet(src)
    journal.write_once(stream(), where, availableNow=True).awaitTermination(120)
    got = journal.written(spark, where, ["n"]).collect()
    assert sorted((r["seq"], r["k"]) for r in got) == [(1, "a"), (2, "b"), (3, "c")]
