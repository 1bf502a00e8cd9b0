"""A crawl as a job: items in order, read in chunks with a journal, capped, stopped and resumed; a stream's sink that writes once.

``Job.run`` plans first: items get their places in the order of their paths, those whose size, time and settings are those of the
previous run's record are reused, and the rest is dealt into chunks. The next chunks are read together, as many as should take
``TOGETHER_S`` at the pace of those before (the first one of a run alone), and written to a folder named by the first of them,
which is overwritten; then all are named in the journal, in one write. A run that dies between the two reads those chunks again, so
rows come neither twice nor in parts; the next ``run`` of the same settings goes on after the journal. Caps stop a session at a
chunk's edge, never before its first chunk. Everything is written by Spark below one folder, which all executors share.

Defined results: repeated paths are one item, the largest (mtime, size_bytes); a null path is none; an empty listing finishes
at once. What is planned and not read yet shows the previous run's record, if there is one, as ``pending``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import UsageError
from ..operators.tables import positions

RUNS = "run long, finished boolean, settings string, items long, chunks long"
#: seconds: a chunk's share of the time of those read with it; null in journals of older versions.
ENTRIES = "chunk long, items long, seconds double"
#: What a kill may cost in work, and what the start of Spark's jobs is spread over.
TOGETHER_S = 30.0


@dataclass(frozen=True)
class Progress:
    run: int
    finished: bool
    items: int  # read in this session
    chunks: int


@dataclass(frozen=True)
class Job:
    """Of items (path, size_bytes, mtime, further columns) in the folder ``where``; ``read`` makes records of them, a row or more each, and keeps their columns."""

    where: str
    read: Callable[[DataFrame], DataFrame] = lambda items: items
    settings: dict | None = None  # of the tool: a record of other settings is read anew
    chunk_items: int = 10_000

    @property
    def _settings(self) -> str:
        return json.dumps(self.settings or {}, sort_keys=True)

    def _table(self, spark: SparkSession, path: str, schema=None) -> DataFrame | None:
        try:
            r = spark.read.schema(schema) if schema else spark.read
            return r.parquet(f"{self.where}/{path}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _last(self, spark: SparkSession) -> tuple:
        """The last run of those that aren't finished, and of those that are; a row each, or None."""
        runs = self._table(spark, "runs", RUNS)
        if runs is None:
            return None, None
        each = runs.groupBy("run").agg(F.bool_or("finished").alias("finished"), F.max("settings").alias("settings"), F.max("items").alias("items"), F.max("chunks").alias("chunks"))
        last = {r["finished"]: r["last"] for r in each.groupBy("finished").agg(F.max(F.struct(*each.columns)).alias("last")).collect()}
        return last.get(False), last.get(True)

    def _note(self, spark: SparkSession, run: int, finished: bool, items: int, chunks: int) -> None:
        spark.createDataFrame([(run, finished, self._settings, items, chunks)], RUNS).coalesce(1).write.mode("append").parquet(f"{self.where}/runs")

    def run(self, items: DataFrame, max_items: int | None = None, max_seconds: float | None = None, restart: bool = False) -> Progress:
        """Reads what is left of an unfinished run, or else begins one over the items; up to the caps."""
        spark = items.sparkSession
        open_, done = self._last(spark)
        if open_ and not restart and (not done or done["run"] < open_["run"]):
            if open_["settings"] != self._settings:
                raise UsageError(f"{self.where} holds an interrupted run with other settings", "finish it with those, or restart")
            now = open_
        else:
            now = self._plan(spark, items, max([r["run"] for r in (open_, done) if r], default=-1) + 1, done)
        run, began, n, chunks = now["run"], time.monotonic(), 0, 0
        journal = self._table(spark, f"run={run}/journal", ENTRIES)
        # a row per chunk
        written = {r["chunk"]: r["seconds"] for r in journal.collect()} if journal is not None else {}
        pace = written[max(written)] if written else None
        left = [(chunk, min(self.chunk_items, now["items"] - chunk * self.chunk_items)) for chunk in range(now["chunks"]) if chunk not in written]
        while left:
            spent = time.monotonic() - began
            if chunks and ((max_items is not None and n >= max_items) or (max_seconds is not None and spent >= max_seconds)):
                return Progress(run, False, n, chunks)
            some, left = self._together(left, pace, None if max_items is None else max_items - n, None if max_seconds is None else max_seconds - spent)
            first = some[0][0]
            self.read(self._planned(spark, run, [chunk for chunk, _ in some])).write.mode("overwrite").parquet(f"{self.where}/run={run}/records/chunk={first}")
            pace = (time.monotonic() - began - spent) / len(some)
            self._entry(spark, run, first, [(chunk, size, pace) for chunk, size in some])
            n, chunks = n + sum(size for _, size in some), chunks + len(some)
        self._note(spark, run, True, now["items"], now["chunks"])
        return Progress(run, True, n, chunks)

    @staticmethod
    def _together(left: list, pace: float | None, items: int | None, seconds: float | None) -> tuple[list, list]:
        """The chunks (number, items) to read next, and those after them: one at least, and none that the caps would leave."""
        most = 1 if pace is None else int(min(TOGETHER_S, TOGETHER_S if seconds is None else seconds) / max(pace, 1e-3))
        k, n = 1, left[0][1]
        while k < min(most, len(left)) and (items is None or n < items):
            k, n = k + 1, n + left[k][1]
        return left[:k], left[k:]

    def _planned(self, spark: SparkSession, run: int, chunks: list[int]) -> DataFrame:
        """The items of some chunks; no other chunk's folder is listed."""
        plan = f"{self.where}/run={run}/plan"
        return spark.read.option("basePath", plan).parquet(*(f"{plan}/chunk={chunk}" for chunk in chunks)).drop("chunk")

    def _entry(self, spark: SparkSession, run: int, first: int, entries: list[tuple[int, int, float]]) -> None:
        """Names the chunks that were read together, from the first one on: all or none."""
        spark.createDataFrame(entries, ENTRIES).coalesce(1).write.mode("append").parquet(f"{self.where}/run={run}/journal")

    def _plan(self, spark: SparkSession, items: DataFrame, run: int, done) -> dict:
        one = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size_bytes"), *(c for c in items.columns if c not in ("path", "mtime", "size_bytes")))
        listed = items.where("path IS NOT NULL").withColumn("__r", F.row_number().over(one)).where("__r = 1").drop("__r")
        listed = positions(listed, [F.col("path")], "seq")
        before = self.records(spark, done["run"]) if done else None
        if before is None:
            fresh = listed.withColumn("change", F.lit("new"))
        else:
            known = before.groupBy("path").agg(F.first("size_bytes").alias("__size"), F.first("mtime").alias("__mtime"))
            same = F.col("size_bytes").eqNullSafe(F.col("__size")) & F.col("mtime").eqNullSafe(F.col("__mtime")) & F.lit(done["settings"] == self._settings)
            marked = listed.join(known.withColumn("__known", F.lit(True)), "path", "left")
            marked = marked.withColumn("change", F.when(F.col("__known").isNull(), "new").when(same, "same").otherwise("changed")).drop("__size", "__mtime", "__known")
            kept = marked.where("change = 'same'").select("path", "seq", "change")
            before.drop("seq", "change").join(kept, "path").write.mode("overwrite").parquet(f"{self.where}/run={run}/reused")
            fresh = marked.where("change <> 'same'")
        fresh = positions(fresh, [F.col("seq")], "__n")
        n = fresh.count()
        chunks = -(-n // self.chunk_items)
        if n:
            dealt = fresh.withColumn("chunk", F.expr(f"(__n - 1) div {self.chunk_items}")).drop("__n")
            dealt.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(f"{self.where}/run={run}/plan")
        self._note(spark, run, False, n, chunks)
        return {"run": run, "items": n, "chunks": chunks}

    def records(self, spark: SparkSession, run: int | None = None) -> DataFrame | None:
        """The records of a run, the last one by default, as far as it has got; ``seq`` is their items' order."""
        if run is None:
            last = [r for r in self._last(spark) if r]
            if not last:
                return None
            run = max(r["run"] for r in last)
        parts = [self._table(spark, f"run={run}/reused")]
        journal = self._table(spark, f"run={run}/journal", ENTRIES)
        written = journal.select("chunk").distinct() if journal is not None else None
        if written is not None:
            read = self._table(spark, f"run={run}/records")
            parts.append(read.join(written, "chunk", "left_semi").drop("chunk"))
        plan = self._table(spark, f"run={run}/plan")
        before = [r for r in self._last(spark)[1:] if r and r["run"] < run]
        if plan is not None and before:
            left = plan if written is None else plan.join(written, "chunk", "left_anti")
            old = self.records(spark, before[0]["run"])
            if old is not None:
                parts.append(old.drop("seq", "change").join(left.select("path", "seq", F.lit("pending").alias("change")), "path"))
        parts = [p for p in parts if p is not None]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out


def write_once(stream: DataFrame, where: str, **trigger):
    """A query that writes each micro-batch to a folder of its own: one that is repeated after a failure overwrites what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", f"{where}/checkpoint").foreachBatch(write).trigger(**trigger).start()


def written(spark: SparkSession, where: str, order: list[str]) -> DataFrame:
    """What ``write_once`` wrote, with ``seq``: batch by batch, by the given columns within."""
    return positions(spark.read.parquet(f"{where}/rows"), [F.col("batch"), *map(F.col, order)], "seq")
