"""Change events: relevance, pauses, quiet-window debouncing and sweeps, as batches and as streams."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tidemark.functions import exprs as X
from tidemark.operators import exact, store
from tidemark.operators.matchers import ExactMatcher, Pipeline
from tidemark.operators.store import Warehouse
from tidemark.sources import crawl


def relevant(events: DataFrame) -> DataFrame:
    """``events``: event_ts, kind, paths."""
    return events.where(X.is_relevant_event(F.col("kind"), F.col("paths")))


def outside_pauses(events: DataFrame, pauses: DataFrame, bucket: str = "hour") -> DataFrame:
    """Events that no pause [from_ts, to_ts) holds; paused events are dropped, not kept for later.

    Starts and ends of pauses and events are put in one order within each hour (``bucket``), and how many
    pauses are open is a running sum, so there is no interval join: rows are events, and two an hour of a pause.
    """
    floor = lambda c: F.date_trunc(bucket, c)
    step = F.expr(f"interval 1 {bucket}")
    p = pauses.where("from_ts < to_ts").select("from_ts", "to_ts", F.explode(F.sequence(floor(F.col("from_ts")), floor(F.col("to_ts")), step)).alias("b"))
    row = F.struct(*[F.col(c) for c in events.columns])
    none = F.lit(None).cast(events.select(row.alias("r")).schema["r"].dataType)
    opened = p.select("b", F.greatest("from_ts", "b").alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("d"), none.alias("r"))
    closed = p.select("b", F.col("to_ts").alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("d"), none.alias("r")).where(F.col("at") < F.col("b") + step)
    here = events.select(floor(F.col("event_ts")).alias("b"), F.col("event_ts").alias("at"), F.lit(2).alias("turn"), F.lit(0).alias("d"), row.alias("r"))
    # ends come first at a time, then starts, then events; in one bucket an end may stand before its own start only if the start is not later
    order = Window.partitionBy("b").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    d = here.unionByName(opened).unionByName(closed).withColumn("depth", F.sum("d").over(order))
    return d.where("turn = 2 and depth = 0").select("r.*")


def due_sweeps(ticks: DataFrame, events: DataFrame, gap: str, pauses: DataFrame) -> DataFrame:
    """Sweeps (``event_ts``) that are carried out: none in a pause, and none while an event's quiet window runs, as that will set off a run itself."""
    pending = relevant(events).select(F.col("event_ts").alias("from_ts"), (F.col("event_ts") + F.expr(f"interval {gap}")).alias("to_ts"))
    return outside_pauses(ticks, pauses.select("from_ts", "to_ts").unionByName(pending))


def debounce(events: DataFrame, gap: str, watermark: str | None = None, key: str | None = None) -> DataFrame:
    """Runs that a quiet window sets off: each event moves the deadline; when it passes, one run starts.

    ``first_ts, last_ts, n_events``, by ``key`` if there is one. The same on a stream, given a watermark.
    """
    e = events.withWatermark("event_ts", watermark) if watermark else events
    w = F.session_window("event_ts", gap)
    if events.isStreaming and not key:
        # a stream has to group a session window by something else too: by what is the same for every event
        key, e = "__all", e.withColumn("__all", F.coalesce(F.year("event_ts") * 0, F.lit(0)))
    d = e.groupBy(w, *([key] if key else [])).agg(F.count(F.lit(1)).alias("n_events"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
    return d.drop("session_window", "__all")


def sweeps(events: DataFrame, period: str) -> DataFrame:
    """Events by period of the sweep."""
    return events.groupBy(F.window("event_ts", period)).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.end").alias("sweep_ts"), "n_events")


def sessions_by_gap(events: DataFrame, seconds: int, key: str) -> DataFrame:
    """Sessions of a key from gaps between its events: the window-function form of ``debounce``."""
    w = Window.partitionBy(key).orderBy("event_ts")
    new = F.when(F.col("event_ts").cast("double") - F.lag("event_ts").over(w).cast("double") < seconds, 0).otherwise(1)
    return events.withColumn("new", new).groupBy(key).agg(F.sum("new").alias("n_sessions"))


def start(events: DataFrame, gap: str, cycle: Callable[[DataFrame, int], None], checkpoint: str, watermark: str = "10 seconds", every: str | None = None) -> StreamingQuery:
    """Run ``cycle`` on each micro-batch of due debounce windows. Stop with ``stop()``; without ``every`` what is there is worked off once."""
    writer = debounce(relevant(events), gap, watermark).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(cycle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


Progress = Callable[[str, int, int], None]


class Watcher:
    """Scans watched paths when a quiet window ends, on a sweep, or when told to, and keeps the results in a warehouse.

    ``status`` is what a status page shows; ``statuses`` yields it whenever it has changed.
    """

    def __init__(self, spark: SparkSession, warehouse: Warehouse, pipeline: Pipeline | None = None, gap: str = "1 second", progress: Progress | None = None):
        self.spark, self.warehouse, self.gap, self.progress = spark, warehouse, gap, progress
        self.pipeline = pipeline or Pipeline().register(ExactMatcher())
        self.watched: set[str] = set()
        self.paused, self.runs, self.query = False, 0, None
        self.status: dict = {"status": "idle", "stage": "", "progress": 0, "files": 0, "run_id": None, "error": None}

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def _tell(self, stage: str, done: int, total: int) -> None:
        self.status = {**self.status, "stage": stage, "progress": 100 * done // total if total else 0, "files": done}
        if self.progress:
            self.progress(stage, done, total)

    def sync(self) -> list[str]:
        """The enabled paths that exist; what is watched follows them."""
        enabled = [r.path for r in self.warehouse.read("watched_paths").where("enabled").select("path").collect()]  # rows somebody entered by hand
        paths = sorted(p for p in enabled if os.path.exists(p))
        self.watched = set(paths)
        return paths

    def cycle(self) -> str | None:
        """Sync, scan, save the run, mark the paths, index the files. The run's id; None if there is nothing to watch."""
        started = time.time()
        roots = self.sync()
        if not roots:
            return None
        self.status = {**self.status, "status": "running", "error": None}
        try:
            self._tell("crawl", 0, 0)
            watched = self.warehouse.read("watched_paths")
            deep = {r.path: r.recursive and not self._is_drive(r.path) for r in watched.where("enabled").collect()}
            parts = [crawl.scan_files(self.spark, rs, recursive=flag) for flag in (True, False) if (rs := [p for p in roots if bool(deep.get(p)) is flag])]
            catalog = reduce(DataFrame.unionByName, parts).dropDuplicates(["path"])
            run_id = f"run_{time.time_ns() // 1000}"
            number = self.warehouse.read("duplicate_clusters").agg(F.coalesce(F.floor(F.max("id") / store.RUN_STRIDE), F.lit(0)).cast("long")).first()[0] + 1
            records = self.pipeline.records(crawl.with_content(catalog)).withColumns({"run_id": F.lit(run_id), "run_no": F.lit(number).cast("long")})
            total = catalog.count()
            self._tell("match", total, total)
            run = store.runs_of(catalog.withColumns({"run_id": F.lit(run_id), "run_no": F.lit(number).cast("long")}), records)
            run = run.withColumns({"timestamp": F.current_timestamp(), "scanned_paths": F.array(*[F.lit(r) for r in roots])})
            if total == 0:
                run = self.spark.createDataFrame([(run_id,)], "run_id string").select(
                    "run_id", F.current_timestamp().alias("timestamp"), F.array(*[F.lit(r) for r in roots]).alias("scanned_paths"), F.lit(0).cast("long").alias("total_files"),
                    F.lit(0).cast("long").alias("duplicate_groups"), F.lit(0).cast("long").alias("wasted_bytes"), F.lit(0.0).alias("duration_seconds"), F.lit("completed").alias("status"),
                )
            self.warehouse.save_run(run.withColumn("duration_seconds", F.lit(time.time() - started)), store.clusters_of(records), store.items_of(records))
            index = self.warehouse.read("file_index")
            moved = store.delta(catalog, index).where("state in ('new', 'changed')").select("path")
            fresh = crawl.with_content(catalog.join(moved, "path", "left_semi"))
            fresh = fresh.select("path", "size_bytes", "modified_epoch", exact.quick_hash().alias("quick_hash"), F.lit(None).cast("string").alias("full_hash"), "category", F.lit(run_id).alias("last_seen_run"))
            self.warehouse.write(watched_paths=store.touch_watched(watched, F.current_timestamp()), file_index=store.upsert(index, fresh, "path"))
            self.runs += 1
            self.status = {**self.status, "status": "completed", "run_id": run_id}
            self._tell("complete", total, total)
            return run_id
        except Exception as e:
            self.status = {**self.status, "status": "failed", "error": str(e)}
            raise

    @staticmethod
    def _is_drive(path: str) -> bool:
        return re.fullmatch(r"/|/(mnt|Volumes)/[^/]+/?", path) is not None

    def trigger(self) -> str | None:
        """A scan at once, paused or not."""
        return self.cycle()

    def sweep(self) -> str | None:
        """A scan from time to time: none while paused or while the stream has a batch at hand, which will set one off itself."""
        busy = self.query is not None and self.query.isActive and self.query.status["isDataAvailable"]
        return None if self.paused or busy else self.cycle()

    def start(self, events: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Follow a stream of events: a batch with quiet windows that have ended sets off one scan."""

        def due(batch: DataFrame, _: int) -> None:
            if not self.paused and not batch.isEmpty():
                self.cycle()

        self.query = start(events, self.gap, due, checkpoint, every=every)
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def statuses(self, seconds: float = 0.5) -> Iterator[dict]:
        """The status at first, and then whenever it has changed, until a scan is over and no stream is followed; groups are not part of it."""
        last = None
        while True:
            now = self.status
            if now != last:
                last = now
                yield dict(now)
            if now["status"] in ("completed", "failed", "idle") and (self.query is None or not self.query.isActive):
                return
            time.sleep(seconds)
