"""Watching acquisitions: the state machine of a data set, over polls as a stream or as a table.

A *look* is what one poll found of one data set: its size and modification time, whether it is still being
acquired, the units (planes, scans, frames) that are there, or the error that opening it gave. A row with a null path ends
a poll, and what the poll did not name is forgotten. Data sets are dealt over ``shards`` by their path's hash; a shard
is one key of a stateful operator, so that the number of tracked data sets has a bound: beyond its share of
``max_tracked`` a shard forgets finished ones, the longest unchanged first.

State, of named variables: per data set its phase and counts; the units reported while it is written, freed when
it is complete; per metric and channel the first values as a baseline or the last gaps. ``watch`` keeps them in a
state store, with a timer that clears a shard no poll has reached for ``forget_s``; ``replay`` keeps them in
dictionaries. Both run ``Tracker``, so a recorded table gives the events of the stream.

Defined results: looks of a poll go by path; a null state is ``complete``; a null or empty list of units has none; an
unknown format (state ``unknown``) stays quiet; a data set's repeated row within a poll counts as a look of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import asdict, dataclass, field, replace
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .rules import DEFAULT_RULES, Rule

UNIT = "kind string, run int, index long, c int, z int, t int, ms_level int, tic double, saturated_fraction double, sharpness double"
LOOK = f"path string, poll long, at double, size_bytes long, mtime double, state string, expected long, error string, units array<struct<{UNIT.replace(' ', ':').replace(',:', ',')}>>"
EVENT = "path string, poll long, n int, event string, at double, state string, run int, index long, c int, z int, t int, complete long, expected long, size_bytes long, mtime double, idle_s double, rule string, metric string, value double, error string"
#: Gaps between time points that an interval's median is taken of.
GAPS = 64
SETTLED = ("complete", "quiet", "failed")


@dataclass(frozen=True)
class Options:
    stall_s: float = 120.0
    live_s: float = 300.0  # what changed so recently and can't be opened may still be written
    trust_first_look: bool = False
    since: float | None = None
    max_tracked: int = 100_000
    shards: int = 64
    forget_s: float = 86_400.0  # a shard that no poll reaches for so long is cleared
    rules: tuple[Rule, ...] = tuple(DEFAULT_RULES)

    @property
    def per_shard(self) -> int:
        return max(-(-self.max_tracked // self.shards), 1)


@dataclass
class Tracked:
    """What is known of a data set between polls."""

    size: int
    mtime: float
    grown: float  # when it last changed, as seen
    phase: str = "pending"  # quiet, pending, in_progress, stalled, complete, failed
    announced: bool = False
    stable: int = 0  # polls in a row that found it unchanged
    planes: int = 0  # reported
    poll: int = 0
    counts: dict[str, int] = field(default_factory=dict)  # of scans and frames reported, by "kind run"


class Tracker:
    """Phases and events of the data sets of a shard; the mappings hold what is remembered.

    sets: path to Tracked; seen: (path, unit) to True; quality: (path, metric, run, c) to [time point, arrival, values].
    """

    def __init__(self, o: Options, sets: MutableMapping, seen: MutableMapping, quality: MutableMapping):
        self.o, self.sets, self.seen, self.quality = o, sets, seen, quality
        self.wanted = {r.metric for r in o.rules}
        self.first = {m: max(r.baseline for r in o.rules if r.metric == m) for m in self.wanted}

    def forget(self, path: str) -> None:
        self.sets.pop(path, None)
        for m in (self.seen, self.quality):
            for k in [k for k in m if k[0] == path]:
                m.pop(k)

    def end_of_poll(self, poll: int) -> None:
        """What this poll didn't name goes; then the bound holds, at the cost of settled data sets."""
        for path in [p for p, t in self.sets.items() if t.poll != poll]:
            self.forget(path)
        excess = len(self.sets) - self.o.per_shard
        if excess > 0:
            settled = sorted((t.mtime, p) for p, t in self.sets.items() if t.phase in SETTLED)
            for _, path in settled[:excess]:
                self.forget(path)

    def look(self, x: dict) -> list[dict]:
        """The events of one look, in order."""
        o, path, at = self.o, x["path"], x["at"]
        t = self.sets.get(path)
        fresh = t is None
        if fresh:
            t = Tracked(x["size_bytes"], x["mtime"], at)
        changed = fresh or (t.size, t.mtime) != (x["size_bytes"], x["mtime"])
        if not fresh:
            t = replace(t, size=x["size_bytes"], mtime=x["mtime"], grown=at if changed else t.grown, stable=0 if changed else t.stable + 1)
        t.poll = x["poll"]
        out: list[dict] = []

        def say(event: str, **more) -> None:
            out.append({"path": path, "poll": x["poll"], "n": len(out), "event": event, "at": at, "size_bytes": t.size, "mtime": t.mtime} | more)

        if fresh and o.since is not None and t.mtime < o.since:
            t.phase = "quiet"
        else:
            if changed or t.phase in ("pending", "in_progress"):
                self._open(x, t, say)
            if t.phase == "in_progress" and at - t.grown >= o.stall_s:
                t.phase = "stalled"
                say("dataset_stalled", state="in_progress", idle_s=round(at - t.grown, 1), complete=t.planes)
        self.sets[path] = t
        return out

    def _open(self, x: dict, t: Tracked, say: Callable) -> None:
        o, state = self.o, x["state"] or "complete"
        if state == "unknown":
            t.phase = "quiet"
            return
        if x["error"] is not None:
            recent = x["at"] - t.mtime <= o.live_s
            if recent and not o.trust_first_look:
                t.phase = "pending"
            elif t.phase != "failed":
                t.phase = "failed"
                say("error", error=x["error"], state="in_progress" if recent else None)
            return
        units = x["units"] if x["units"] is not None else []
        planes = [u for u in units if u["kind"] == "plane"]
        there = max([u["index"] + 1 for u in planes], default=t.planes)
        expected = x["expected"] if x["expected"] is not None else there if state == "complete" else None
        if not t.announced:
            t.announced = True
            say("dataset_new", state=state, complete=there, expected=expected)
        if state == "in_progress" and (t.phase != "stalled" or t.stable == 0):
            t.phase = "in_progress"  # also when it grows again after a stall
        for u in planes:
            key = (x["path"], f"{u['run']} {u['c']} {u['z']} {u['t']}")
            # planes of a finished data set go by their place: its last metadata may number them anew
            if u["index"] < t.planes if state == "complete" else key in self.seen:
                continue
            if state != "complete":
                self.seen[key] = True
            t.planes += 1
            say("plane_new", state=state, run=u["run"], c=u["c"], z=u["z"], t=u["t"], index=t.planes - 1, complete=there, expected=expected)
            self._judge(x, u, say, state, t.planes - 1)
        for u in units:
            known = f"{u['kind']} {u['run']}"
            if u["kind"] in ("scan", "frame") and u["index"] >= t.counts.get(known, 0):
                t.counts = t.counts | {known: u["index"] + 1}
                say(f"{u['kind']}_new", state=state, run=u["run"], index=u["index"], complete=u["index"] + 1)
                self._judge(x, u, say, state, u["index"])
        if state == "complete" and t.phase != "complete":
            if o.trust_first_look or t.stable >= 1:
                t.phase = "complete"
                for k in [k for k in self.seen if k[0] == x["path"]]:
                    self.seen.pop(k)
                say("dataset_complete", state="complete", complete=max(t.planes, there), expected=expected)
            else:
                t.phase = "in_progress"
        elif state == "interrupted" and t.phase != "stalled":
            t.phase = "stalled"
            say("dataset_stalled", state="interrupted", idle_s=float(round(x["at"] - t.mtime)), complete=there, expected=expected)

    def _judge(self, x: dict, u: dict, say: Callable, state: str, index: int) -> None:
        """qc events of a new unit."""
        technique = "mass_spectrometry" if u["kind"] == "scan" else "imaging"
        for metric, value in self._metrics(x, u):
            for r in self.o.rules:
                if r.metric == metric and r.technique in (None, "any", technique) and ((r.min is not None and value < r.min) or (r.max is not None and value > r.max)):
                    say("qc", state=state, run=u["run"], index=index, c=u["c"], z=u["z"], t=u["t"], rule=r.name, metric=metric, value=round(value, 6))

    def _metrics(self, x: dict, u: dict) -> Iterator[tuple[str, float]]:
        if u["kind"] == "plane":
            if u["saturated_fraction"] is not None and "saturated_fraction" in self.wanted:
                yield "saturated_fraction", u["saturated_fraction"]
            yield from self._to_baseline(x["path"], "sharpness_ratio", u["run"], u["c"], u["sharpness"])
            yield from self._interval(x, u)
        elif u["kind"] == "scan" and u["ms_level"] == 1:
            yield from self._to_baseline(x["path"], "tic_ratio", -1, -1, u["tic"])

    def _to_baseline(self, path: str, metric: str, run: int, c: int, value: float | None) -> Iterator[tuple[str, float]]:
        """value over the median of the first ones, which aren't judged themselves."""
        if metric not in self.wanted or value is None or value != value or value in (float("inf"), float("-inf")):
            return
        key = (path, metric, run, c)
        base = self.quality.get(key, [0, 0.0, []])[2]
        if len(base) < self.first[metric]:
            self.quality[key] = [0, 0.0, [*base, value]]
        elif base and (m := median(base)) > 0:
            yield metric, value / m

    def _interval(self, x: dict, u: dict) -> Iterator[tuple[str, float]]:
        """The gap before a new time point over the median of the last ones."""
        if "interval_ratio" not in self.wanted or u["t"] is None:
            return
        key = (x["path"], "interval_ratio", u["run"], -1)
        known = self.quality.get(key)
        if known is None:
            self.quality[key] = [u["t"], x["at"], []]
        elif u["t"] > known[0]:
            gap, gaps = x["at"] - known[1], known[2]
            if len(gaps) >= self.first["interval_ratio"] and gaps and (m := median(gaps)) > 0:
                yield "interval_ratio", gap / m
            self.quality[key] = [u["t"], x["at"], [*gaps, gap][-GAPS:]]


def _looks(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Rows in order of polls, a poll's end last; missing values as None."""
    pdf = pd.concat(list(frames), ignore_index=True)
    names = [c for c in pdf.columns if c != "shard"]
    rows = [{k: None if not isinstance(v, (list, dict)) and not hasattr(v, "__len__") and pd.isna(v) else v for k, v in zip(names, r, strict=True)} for r in pdf[names].itertuples(index=False)]
    for r in sorted(rows, key=lambda r: (r["poll"], r["path"] is None, r["path"] or "", r["at"])):
        yield r | {k: int(r[k]) for k in ("poll", "size_bytes", "expected") if r[k] is not None} | ({"units": [_unit(u) for u in r["units"]]} if r["units"] is not None else {})


def _unit(u) -> dict:
    """A unit as a dictionary of plain values."""
    d = u if isinstance(u, dict) else u.asDict()
    whole = ("run", "index", "c", "z", "t", "ms_level")  # which may come as floats beside nulls
    return {k: None if v is None or v != v else int(v) if k in whole else v for k, v in d.items()}


def _events(tracker: Tracker, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    out: list[dict] = []
    for x in _looks(frames):
        if x["path"] is None:
            tracker.end_of_poll(x["poll"])
        else:
            out += tracker.look(x)
    return pd.DataFrame([[e.get(c) for c in _names(EVENT)] for e in out], columns=_names(EVENT), dtype=object)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def dealt(looks: DataFrame, o: Options) -> DataFrame:
    """looks by shard; the end of a poll goes to every shard."""
    shard = F.pmod(F.xxhash64("path"), F.lit(o.shards)).cast("int")
    all_shards = F.sequence(F.lit(0), F.lit(o.shards - 1))
    return looks.select(F.explode(F.when(F.col("path").isNull(), all_shards).otherwise(F.array(shard))).alias("shard"), *_names(LOOK.split(", units")[0]), "units")


def counted(polls: DataFrame, kind: str = "frame") -> DataFrame:
    """Looks of polls that know counts alone: path, at, size_bytes, mtime, units (how many), and state, if there is one."""
    n = F.coalesce(F.col("units"), F.lit(0)).cast("long")
    of = lambda i: f"named_struct('kind', '{kind}', 'run', 0, 'index', {i}, 'c', cast(null as int), 'z', cast(null as int), 't', cast(null as int), 'ms_level', cast(null as int), 'tic', cast(null as double), 'saturated_fraction', cast(null as double), 'sharpness', cast(null as double))"
    units = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.expr(of("0L")).withField("index", i)))
    none = lambda kind: F.lit(None).cast(kind)
    state = F.col("state") if "state" in polls.columns else none("string")
    return polls.select("path", (F.col("at") * 1000).cast("long").alias("poll"), "at", "size_bytes", "mtime", state.alias("state"), none("long").alias("expected"), none("string").alias("error"), units.alias("units"))


def replay(looks: DataFrame, o: Options = Options()) -> DataFrame:
    """The events (``EVENT``) of a recorded table of looks (``LOOK``)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _events(Tracker(o, {}, {}, {}), iter([pdf]))

    return dealt(looks, o).groupBy("shard").applyInPandas(run, EVENT)


class _Kept(dict):
    """A state variable as a dictionary: read at once, as a poll looks at all of a shard, and what changed is written at the end."""

    def __init__(self, state, pack: Callable, unpack: Callable):
        super().__init__((tuple(k) if len(k) > 1 else k[0], unpack(v)) for k, v in state.iterator())
        self.state, self.pack = state, pack
        self.changed: set = set()
        self.known = set(self)

    def __setitem__(self, key, value) -> None:
        super().__setitem__(key, value)
        self.changed.add(key)

    def pop(self, key, *other):
        self.changed.add(key)
        return super().pop(key, *other)

    def write(self) -> None:
        for key in self.changed:
            at = key if isinstance(key, tuple) else (key,)
            if key in self:
                self.state.updateValue(at, self.pack(self[key]))
            elif key in self.known:
                self.state.removeKey(at)


_SET = "size long, mtime double, grown double, phase string, announced boolean, stable int, planes long, poll long, known array<string>, reported array<long>"


def _pack(t: Tracked) -> tuple:
    d = asdict(t)
    counts = d.pop("counts")
    return (*d.values(), list(counts), list(counts.values()))


def _unpack(v) -> Tracked:
    return Tracked(*tuple(v)[:-2], counts=dict(zip(v[-2], v[-1], strict=True)))


class Acquisitions(StatefulProcessor):
    """``Tracker`` on Spark's state: one key is a shard."""

    def __init__(self, o: Options):
        self.o = o

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sets = handle.getMapState("sets", "path string", _SET)
        self.seen = handle.getMapState("seen", "path string, unit string", "there boolean")
        self.quality = handle.getMapState("quality", "path string, metric string, run int, c int", "t int, at double, reference array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sets = _Kept(self.sets, _pack, _unpack)
        seen = _Kept(self.seen, lambda v: (v,), lambda v: v[0])
        quality = _Kept(self.quality, tuple, lambda v: [v[0], v[1], list(v[2])])
        out = _events(Tracker(self.o, sets, seen, quality), rows)
        for m in (sets, seen, quality):
            m.write()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.o.forget_s * 1000))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.sets, self.seen, self.quality):
            state.clear()
        yield pd.DataFrame({c: [] for c in _names(EVENT)}, dtype=object)

    def close(self) -> None:
        pass


def watch(looks: DataFrame, o: Options = Options()) -> DataFrame:
    """The events (``EVENT``) of a stream of looks (``LOOK``); the session needs the RocksDB state store."""
    return dealt(looks, o).groupBy("shard").transformWithStateInPandas(Acquisitions(o), EVENT, "append", "ProcessingTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
