import random
import time

import pytest
from pyspark.sql import functions as F

from fathomry.streaming import tracker, watch

POLLS = "path string, at double, size_bytes long, mtime double, units long, state string"
NONE = {"expected": None, "error": None, "units": None, "state": None}


def until(q, done, seconds=90):
    """Waits for done(), then stops the stream: with a processing-time timeout it goes on running batches."""
    end = time.time() + seconds
    while not done() and q.isActive and time.time() < end:
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None


def unit(kind, run, index, **more):
    return {"kind": kind, "run": run, "index": index, "c": None, "z": None, "t": None, "ms_level": None, "tic": None, "saturated_fraction": None, "sharpness": None} | more


def look(path, poll, at, size, mtime, **more):
    return NONE | {"path": path, "poll": poll, "at": at, "size_bytes": size, "mtime": mtime} | more


def frame(spark, looks):
    names = tracker._names(tracker.LOOK.split(", units")[0]) + ["units"]
    return spark.createDataFrame([tuple(x[n] for n in names) for x in looks], tracker.LOOK)


def by_hand(looks, o):
    """The tracker over one list of looks, as one shard."""
    t, out = tracker.Tracker(o, {}, {}, {}), []
    for x in looks:
        if x["path"] is None:
            t.end_of_poll(x["poll"])
        else:
            out += t.look(x)
    return out, t


def kinds(events):
    return [(e["path"], e["poll"], e["event"]) for e in events]


def test_what_once_grew_completes():
    looks = [look("a", i, 10.0 * i, size, float(size), units=[unit("frame", 0, k) for k in range(n)]) for i, (size, n) in enumerate([(10, 1), (20, 2), (20, 2), (20, 2)])]
    got, _ = by_hand(looks, watch.Options())
    assert [e["event"] for e in got] == ["dataset_new", "frame_new", "frame_new", "dataset_complete"]
    assert got[-1]["poll"] == 2


def test_running_stalled_and_back_to_life():
    rows = [(0, 10), (10, 20), (100, 20), (131, 20), (140, 20), (150, 30), (300, 30)]
    looks = [look("a", i, float(at), size, float(size), state="in_progress") for i, (at, size) in enumerate(rows)] + [look("a", 9, 310.0, 30, 30.0), look("a", 10, 320.0, 31, 31.0), look("a", 11, 330.0, 31, 31.0)]
    got, _ = by_hand(looks, watch.Options())
    assert kinds(got) == [("a", 0, "dataset_new"), ("a", 3, "dataset_stalled"), ("a", 6, "dataset_stalled"), ("a", 11, "dataset_complete")]
    assert got[1]["idle_s"] == 121.0 and got[2]["state"] == "in_progress"


def test_errors_pending_unknown_and_since():
    o = watch.Options(live_s=50, since=100.0)
    looks = [
        look("new", 0, 200.0, 5, 190.0, error="header"), look("new", 1, 210.0, 6, 205.0), look("new", 2, 220.0, 6, 205.0),
        look("bad", 0, 200.0, 5, 190.0, error="header"), look("bad", 1, 245.0, 5, 190.0, error="header"), look("bad", 2, 255.0, 6, 200.0, error="header"),
        look("what", 0, 200.0, 5, 190.0, state="unknown"),
        look("old", 0, 200.0, 5, 90.0), look("old", 1, 210.0, 5, 90.0), look("old", 2, 220.0, 7, 219.0), look("old", 3, 230.0, 7, 219.0),
        look("cut", 0, 200.0, 5, 190.0, state="interrupted"), look("cut", 1, 210.0, 5, 190.0, state="interrupted"),
    ]
    got, _ = by_hand(looks, o)
    assert kinds(got) == [("new", 1, "dataset_new"), ("new", 2, "dataset_complete"), ("bad", 1, "error"), ("old", 2, "dataset_new"), ("old", 3, "dataset_complete"), ("cut", 0, "dataset_new"), ("cut", 0, "dataset_stalled")]
    once, _ = by_hand([look("x", 0, 9.0, 1, 9.0)], watch.Options(trust_first_look=True))
    assert [e["event"] for e in once] == ["dataset_new", "dataset_complete"]


def test_planes_are_told_once_and_by_place_when_finished():
    plane = lambda i, z: unit("plane", 0, i, c=0, z=z, t=0, saturated_fraction=0.5 if i == 2 else 0.0, sharpness=[8.0, 4.0, 2.0, 1.0, 9.0][i])
    looks = [look("a", i, 10.0 * i, i, float(i), state="in_progress", expected=5, units=[plane(k, k) for k in range(i + 1)]) for i in range(4)]
    looks += [look("a", i, 10.0 * i, 9, 9.0, units=[plane(k, 40 + k) for k in range(5)]) for i in (4, 5, 6)]  # numbered anew
    got, t = by_hand(looks, watch.Options())
    new = [e for e in got if e["event"] == "plane_new"]
    assert [e["index"] for e in new] == [0, 1, 2, 3, 4] and [e["z"] for e in new] == [0, 1, 2, 3, 44] and {e["expected"] for e in new} == {5}
    qc = [(e["rule"], e["index"], e["value"]) for e in got if e["event"] == "qc"]
    assert qc == [("saturation", 2, 0.5), ("focus_drift", 3, 0.25)]  # 1 over the median of 8, 4 and 2
    assert got[-1]["event"] == "dataset_complete" and got[-1]["complete"] == 5 and not t.seen


def test_intervals_and_scans():
    gaps = [1.0, 1.0, 1.0, 5.0, 1.0]
    at = [0.0]
    for g in gaps:
        at.append(at[-1] + g)
    looks = [look("p", i, x, i, x, state="in_progress", units=[unit("plane", 0, i, c=0, z=0, t=i)]) for i, x in enumerate(at)]
    got, t = by_hand(looks, watch.Options())
    assert [(e["metric"], e["value"], e["index"]) for e in got if e["event"] == "qc"] == [("interval_ratio", 5.0, 4)]
    tics = [10.0, 12.0, 8.0, 10.0, 11.0, 1.0, 10.0]
    scans = [unit("scan", 0, i, ms_level=1, tic=x) for i, x in enumerate(tics)] + [unit("scan", 0, 7, ms_level=2, tic=0.1)]
    got, t = by_hand([look("m", 0, 0.0, 1, 0.0, units=scans), look("m", 1, 1.0, 1, 0.0, units=scans)], watch.Options())
    assert [e["event"] for e in got].count("scan_new") == 8 and [(e["rule"], e["index"]) for e in got if e["event"] == "qc"] == [("tic_drop", 5)]
    many = [look("p", i, float(i), i, float(i), state="in_progress", units=[unit("plane", 0, i, c=0, z=0, t=i)]) for i in range(200)]
    assert max(len(v[2]) for v in by_hand(many, watch.Options())[1].quality.values()) == tracker.GAPS


def test_what_is_gone_and_what_is_too_much_is_forgotten():
    o = watch.Options(max_tracked=3, shards=1)
    looks = []
    for p in range(4):
        looks += [look(f"d{k}", p, 10.0 * p, 1, float(k)) for k in range(6)] + [look("busy", p, 10.0 * p, p, float(p), state="in_progress"), look(None, p, 10.0 * p, None, None)]
    got, t = by_hand(looks, o)
    assert len(t.sets) <= 3 + 1 and "busy" in t.sets
    _, t = by_hand([*looks, look("d5", 9, 99.0, 1, 5.0), look(None, 9, 99.0, None, None)], o)
    assert set(t.sets) == {"d5"} and not t.seen


def recorded(seed=5):
    """Polls of some data sets of every fate, all in one table."""
    r = random.Random(seed)
    out = []
    sets = {f"set{i}": {"size": 0, "m": 0.0, "n": 0, "fate": i % 6} for i in range(24)}
    for poll in range(14):
        at = 40.0 * poll
        for path, s in sets.items():
            if s["fate"] == 5 and poll in (6, 7):
                continue  # gone, then back
            grows = poll < 5 or (s["fate"] == 2 and poll in (10, 11))
            if grows:
                s["size"], s["m"], s["n"] = s["size"] + r.randint(0, 3), at - 1, s["n"] + r.randint(0, 2)
            state = {1: "in_progress", 2: "in_progress" if poll < 11 else None, 3: "interrupted" if poll > 6 else "in_progress"}.get(s["fate"])
            kind = ["plane", "scan", "frame"][len(path) % 2 + s["fate"] % 2]
            more = {"plane": {"c": 0, "z": 0, "t": 1}, "scan": {"ms_level": 1}, "frame": {}}[kind]
            units = [unit(kind, 0, k, **(more | ({"t": k, "sharpness": 9.0 / (k + 1), "saturated_fraction": k / 50} if kind == "plane" else {"tic": 5.0 - k} if kind == "scan" else {}))) for k in range(s["n"])]
            out.append(look(path, poll, at, s["size"], s["m"], state=state, error="no header" if s["fate"] == 4 and poll < 9 else None, units=units or None))
        out.append(look(None, poll, at, None, None))
    return out


def plain(rows):
    return sorted(repr(tuple(r.get(c) if isinstance(r, dict) else r[c] for c in tracker._names(tracker.EVENT))) for r in rows)


O = watch.Options(stall_s=100, live_s=60, shards=4, max_tracked=400)


def test_replay_is_the_tracker(spark):
    looks = recorded()
    got = watch.replay(frame(spark, looks).repartition(5), O).collect()
    want, _ = by_hand(sorted(looks, key=lambda x: (x["poll"], x["path"] is None, x["path"] or "")), O)
    assert plain(got) == plain(want)
    assert {e["event"] for e in got} == set(watch.EVENTS)


def test_counted_polls(spark):
    rows = [("a", 0.0, 10, 0.0, 1, None), ("a", 10.0, 20, 10.0, 2, None), ("a", 20.0, 20, 10.0, 2, None), ("b", 0.0, 5, 0.0, 0, "in_progress"), ("b", 130.0, 5, 0.0, None, "in_progress")]
    got = watch.replay(watch.counted(spark.createDataFrame(rows, POLLS))).collect()
    assert sorted((r["path"], r["at"], r["event"]) for r in got) == [("a", 0.0, "dataset_new"), ("a", 0.0, "frame_new"), ("a", 10.0, "frame_new"), ("a", 20.0, "dataset_complete"), ("b", 0.0, "dataset_new"), ("b", 130.0, "dataset_stalled")]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, tracker.ROCKSDB)
    yield
    spark.conf.set(key, old)


def test_stream_gives_the_replays_events(spark, tmp_path, rocksdb):
    """Some polls a batch, over two runs of the query: state goes on from the checkpoint."""
    looks, src = recorded(), str(tmp_path / "in")
    run = 0

    def some(polls):
        nonlocal run
        run += 1
        frame(spark, [x for x in looks if x["poll"] in polls]).coalesce(1).write.mode("append").parquet(src)
        q = watch.watch(spark.readStream.schema(tracker.LOOK).parquet(src), O).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        rows = sum(x["poll"] in polls for x in looks)
        until(q, lambda: sum(p["numInputRows"] for p in q.recentProgress) >= rows)
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    some(range(0, 7))
    kept = some(range(7, 14))
    got = spark.read.schema(tracker.EVENT).parquet(str(tmp_path / "out")).collect()
    assert plain(got) == plain(watch.replay(frame(spark, looks), O).collect())
    assert kept[-1] < 24 * 8


def test_event_time_windows_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 00:00:10", "x", 1.0), ("2024-01-01 00:00:50", "x", 3.0), ("2024-01-01 00:02:00", "x", 5.0)], "ts string, k string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    s = watch.tumbling(spark.readStream.schema("ts timestamp, k string, value double").parquet(src), "ts", "1 minute", ["k"])
    q = s.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["mean"]) for r in spark.table("windowed").collect()) == [(1, 5.0), (2, 2.0)]


def test_rules(spark, tmp_path):
    m = spark.createDataFrame([("a", "saturated_fraction", 0.5, 0), ("a", "sharpness_ratio", 0.1, 1), ("a", "sharpness_ratio", 0.1, 5), ("a", "tic_ratio", None, 9)], "path string, metric string, value double, n int")
    assert sorted((r["metric"], r["n"]) for r in watch.judge(m).collect()) == [("saturated_fraction", 0), ("sharpness_ratio", 5)]
    (tmp_path / "r.toml").write_text('[[rule]]\nname = "x"\nmetric = "m"\nmax = 1.0\n')
    assert watch.load_rules(str(tmp_path / "r.toml")) == [watch.Rule("x", "m", max=1.0)]
