"""Persisted runs: five tables as Parquet snapshots, and what reads and rewrites them.

A change is a function from tables to tables; ``Warehouse`` writes the result as new
snapshots and then the next pointer, so readers see either state and a failed write
changes nothing. Tables of runs are kept by run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.errors import StoreError
from tidemark.functions import exprs as X
from tidemark.schemas import TABLES

#: Clusters and items of a run are numbered within it; the run's number comes first, with room for 2**40 of each and 2**22 runs.
RUN_STRIDE = 1 << 40


@dataclass
class RunTables:
    runs: DataFrame
    clusters: DataFrame
    items: DataFrame


def clusters_of(records: DataFrame) -> DataFrame:
    """Cluster rows of records by run: attributes are those of the kept member."""
    r = records.where("rank = 1")
    key = (F.col("run_no") * RUN_STRIDE + F.col("group_id")).alias("id")
    return r.select(key, "run_id", F.col("group_id").alias("cluster_id"), "match_type", "category", "similarity_score")


def items_of(records: DataFrame) -> DataFrame:
    cluster = F.col("run_no") * RUN_STRIDE + F.col("group_id")
    return records.select((F.col("run_no") * RUN_STRIDE + F.col("member_no")).alias("id"), cluster.alias("cluster_id"), "path", "action", "size_bytes", "dimensions")


def runs_of(files: DataFrame, records: DataFrame) -> DataFrame:
    """Run rows: files seen, clusters, and bytes wasted."""
    seen = files.groupBy("run_id", "run_no").agg(F.count(F.lit(1)).alias("total_files"))
    found = records.groupBy("run_id").agg(F.count_if(F.col("rank") == 1).alias("g"), F.sum(F.when(F.col("action") == "DUPLICATE", F.col("size_bytes"))).alias("w"))
    d = seen.join(found, "run_id", "left")
    return d.select(
        "run_id", F.timestamp_seconds(F.lit(1700000000) + F.col("run_no") * 3600).alias("timestamp"), F.array(F.lit("/vault")).alias("scanned_paths"), "total_files",
        F.coalesce("g", F.lit(0)).cast("long").alias("duplicate_groups"), F.coalesce("w", F.lit(0)).cast("long").alias("wasted_bytes"), F.lit(1.5).alias("duration_seconds"), F.lit("completed").alias("status"),
    )


def upsert(current: DataFrame, changes: DataFrame, key: str, newest: str | None = None) -> DataFrame:
    """Rows of ``changes`` take the place of those of the same key. Of several changes of one key that of the
    greatest ``newest`` counts, or, without it or among equal ones, the greatest row."""
    whole = F.struct(*[F.col(c) for c in current.columns])
    order = F.struct(F.col(newest), whole) if newest else whole
    one = changes.groupBy(key).agg(F.max_by(whole, order).alias("__r")).select("__r.*")
    return current.join(one.select(key), key, "left_anti").select(*current.columns).unionByName(one)


def upsert_runs(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Run rows by their id; of several of one id the latest."""
    return upsert(runs, changes, "run_id", "timestamp")


def add_items(items: DataFrame, cluster: int, records: DataFrame) -> DataFrame:
    """Records (path, action, size_mb, dimensions) become items of a cluster; ids go on from the greatest there is."""
    top = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).withColumn("j", F.lit(1))
    new = records.withColumn("j", F.lit(1)).join(top, "j").withColumn("k", F.row_number().over(Window.partitionBy("j").orderBy("path")))
    new = new.select((F.col("top") + F.col("k")).alias("id"), F.lit(cluster).cast("long").alias("cluster_id"), "path", "action", X.bytes_of_mb(F.col("size_mb")).alias("size_bytes"), "dimensions")
    return items.unionByName(new.select(*items.columns))


def run_history(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(n)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run; of runs of one second the one of the greatest id."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("timestamp", "run_id")).alias("r")).select("r.*")


def clusters_with_items(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Clusters with their items as a list, by one join."""
    own = items.groupBy(F.col("cluster_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("item_id"), "path", "action", "size_bytes"))).alias("items"))
    return clusters.join(own, "id", "left")


def cluster_page(clusters: DataFrame, run_id: str, category: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    d = clusters.where(F.col("run_id") == run_id)
    return (d.where(F.col("category") == category) if category else d).orderBy("id").offset(offset).limit(limit)


def override_keeper(items: DataFrame, cluster: int, path: str) -> DataFrame:
    """The file of that path is kept and all others of its cluster are not; nothing changes if the cluster has no such file."""
    here = F.col("cluster_id") == cluster
    known = items.where(here & (F.col("path") == path)).select("cluster_id").distinct().withColumn("found", F.lit(True))
    d = items.join(F.broadcast(known), "cluster_id", "left")  # one row at most
    return d.withColumn("action", F.when(F.col("found"), F.when(F.col("path") == path, "KEEP").otherwise("DUPLICATE")).otherwise(F.col("action"))).drop("found")


def exhausted_clusters(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Clusters with no duplicate left."""
    return clusters.join(items.where("action = 'DUPLICATE'").select(F.col("cluster_id").alias("id")), "id", "left_anti")


def items_without(items: DataFrame, paths: DataFrame) -> DataFrame:
    return items.join(paths.select("path").distinct(), "path", "left_anti")


def freed_space(items: DataFrame, paths: DataFrame) -> DataFrame:
    """What goes with the paths: only duplicates count as removed and freed."""
    gone = items.join(paths.select("path").distinct(), "path", "left_semi")
    return gone.agg(F.count_if(F.col("action") == "DUPLICATE").alias("removed"), F.coalesce(F.sum(F.when(F.col("action") == "DUPLICATE", F.col("size_bytes"))), F.lit(0)).cast("long").alias("freed_bytes"))


def recomputed_runs(runs: DataFrame, clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with groups and waste counted anew."""
    dup = items.where("action = 'DUPLICATE'").groupBy(F.col("cluster_id").alias("id")).agg(F.sum("size_bytes").alias("w"))
    per = clusters.join(dup, "id", "left").groupBy("run_id").agg(F.countDistinct("id").alias("g"), F.sum("w").alias("w"))
    d = runs.drop("duplicate_groups", "wasted_bytes").join(per, "run_id", "left")
    return d.withColumns({"duplicate_groups": F.coalesce("g", F.lit(0)).cast("long"), "wasted_bytes": F.coalesce("w", F.lit(0)).cast("long")}).select(*runs.columns)


def remove_paths(t: RunTables, paths: DataFrame) -> RunTables:
    """Items of the paths go, then clusters without a duplicate with what they hold, then runs are counted anew."""
    items = items_without(t.items, paths)
    spent = exhausted_clusters(t.clusters, items).select("id")
    clusters = t.clusters.join(spent, "id", "left_anti")
    items = items.join(spent.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti").select(*t.items.columns)
    return RunTables(recomputed_runs(t.runs, clusters, items), clusters, items)


def missing_paths(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Paths of duplicates that are on disk no more."""
    return items.where("action = 'DUPLICATE'").select("path").distinct().join(catalog.select("path"), "path", "left_anti")


def prune(t: RunTables, catalog: DataFrame) -> tuple[RunTables, DataFrame]:
    """Duplicates that are on disk no more go as if they had been deleted; what that removes and frees as one row."""
    gone = missing_paths(t.items, catalog)
    return remove_paths(t, gone), freed_space(t.items, gone)


def cached_file(index: DataFrame, path: str) -> DataFrame:
    """The indexed file of a path, or no row."""
    return index.where(F.col("path") == path)


def forget_file(index: DataFrame, path: str) -> DataFrame:
    return index.where(F.col("path") != path)


def delete_run(t: RunTables, index: DataFrame, run_id: str) -> tuple[RunTables, DataFrame]:
    """A run goes with its clusters and items; files last seen by it lose that mark."""
    gone = t.clusters.where(F.col("run_id") == run_id).select(F.col("id").alias("cluster_id"))
    kept = RunTables(t.runs.where(F.col("run_id") != run_id), t.clusters.where(F.col("run_id") != run_id), t.items.join(gone, "cluster_id", "left_anti").select(*t.items.columns))
    return kept, index.withColumn("last_seen_run", F.when(F.col("last_seen_run") != run_id, F.col("last_seen_run")))


def delta(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """Each path with its ``state``: unchanged (size and time agree), changed, new, or gone."""
    i = index.select("path", F.col("size_bytes").alias("i_size"), F.col("modified_epoch").alias("i_time"), F.lit(1).alias("indexed"))
    d = catalog.select("path", "size_bytes", "modified_epoch", F.lit(1).alias("present")).join(i, "path", "full")
    same = (F.col("size_bytes") == F.col("i_size")) & (F.col("modified_epoch") == F.col("i_time"))
    state = F.when(F.col("present").isNull(), "gone").when(F.col("indexed").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return d.select("path", "size_bytes", "modified_epoch", state.alias("state"))


def index_after_run(index: DataFrame, catalog: DataFrame, run_id: str, quick) -> DataFrame:
    """The index with new and changed files written over; gone ones go. ``catalog`` has content."""
    moved = delta(catalog, index).where("state in ('new', 'changed')").select("path")
    fresh = catalog.join(moved, "path", "left_semi").select("path", "size_bytes", "modified_epoch", quick.alias("quick_hash"), F.lit(None).cast("string").alias("full_hash"), "category", F.lit(run_id).alias("last_seen_run"))
    return upsert(index.join(catalog.select("path"), "path", "left_semi"), fresh, "path")


def group_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("run_id", "match_type").agg(F.count(F.lit(1)).alias("n_groups"))


def reloaded_summary(t: RunTables) -> DataFrame:
    """A summary of each run from the tables alone; sizes are not rounded, and a duplicate counts under its cluster's category."""
    per = t.items.where("action = 'DUPLICATE'").groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("w"))
    c = t.clusters.join(per, "id", "left").groupBy("run_id", "category").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_duplicates"))
    return c.join(t.runs.select("run_id", "total_files", "duplicate_groups", (F.col("wasted_bytes") / float(X.MB)).alias("wasted_mb")), "run_id")


class Warehouse:
    """The tables in a folder.

    ``<root>/<table>/<snapshot>`` holds files; ``<root>/_pointers/<number>`` says which snapshots make up which
    table. Tables of runs are made up of parts, one a run, so saving a run writes that run alone. A change writes
    its snapshots and then the next pointer, as one rename; readers take the greatest pointer, so they see the state
    before or after it, and a writer that dies leaves the state before. Of two writers at once one fails.
    """

    #: Tables whose parts are runs.
    BY_RUN = ("scan_runs", "duplicate_clusters", "duplicate_items")
    #: Older pointers that are kept for readers that have just taken one.
    KEPT_POINTERS = 5

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        p, fs = self._fs(f"{self.root}/_pointers")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> dict[tuple[str, str], str]:
        """Snapshots by table and part; the part is the run's id, or '' for what is not parted."""
        numbers = self._numbers()
        if not numbers:
            return {}
        return {(r.name, r.part): r.snapshot for r in self.spark.read.schema("name string, part string, snapshot string").json(f"{self.root}/_pointers/{numbers[-1]:012d}").collect()}

    def read(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise StoreError(f"there is no table {name!r}")
        paths = [f"{self.root}/{name}/{snapshot}" for (table, _), snapshot in self.current().items() if table == name]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def _put(self, name: str, df: DataFrame) -> str:
        if name not in TABLES:
            raise StoreError(f"there is no table {name!r}")
        snapshot = uuid.uuid4().hex
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]).write.parquet(f"{self.root}/{name}/{snapshot}")
        return snapshot

    def _point(self, now: dict[tuple[str, str], str]) -> None:
        """Make a state the current one: a few rows a run, written aside and renamed to the next number."""
        numbers = self._numbers()
        new = numbers[-1] + 1 if numbers else 0
        aside = f"{self.root}/_aside-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(n, part, s) for (n, part), s in now.items()], "name string, part string, snapshot string").coalesce(1).write.json(aside)
        (source, fs), (target, _) = self._fs(aside), self._fs(f"{self.root}/_pointers/{new:012d}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            raise StoreError("another writer was first; read again and retry")
        for n in numbers[: -self.KEPT_POINTERS]:
            fs.delete(self._fs(f"{self.root}/_pointers/{n:012d}")[0], True)

    def write(self, **tables: DataFrame) -> None:
        """New contents of whole tables, all visible at once."""
        now = self.current()
        for name, df in tables.items():
            snapshot = self._put(name, df)
            now = {k: v for k, v in now.items() if k[0] != name}
            now[name, ""] = snapshot
        self._point(now)

    def save_run(self, runs: DataFrame, clusters: DataFrame, items: DataFrame) -> None:
        """Write one run; what was saved of the same id goes. Other runs' files are not touched, unless a whole table
        written at once holds the run too: that table is then written anew without it."""
        ids = [r.run_id for r in runs.select("run_id").distinct().limit(2).collect()]
        if len(ids) != 1:
            raise StoreError("a run is saved by itself")
        now = self.current()
        if ("scan_runs", "") in now:
            whole = {n: self.spark.read.schema(TABLES[n]).parquet(f"{self.root}/{n}/{now[n, '']}") for n in self.BY_RUN if (n, "") in now}
            t = RunTables(whole["scan_runs"], whole.get("duplicate_clusters", self.read("duplicate_clusters")), whole.get("duplicate_items", self.read("duplicate_items")))
            if not t.runs.where(F.col("run_id") == ids[0]).isEmpty():
                left, _ = delete_run(t, self.read("file_index"), ids[0])
                for n, d in (("scan_runs", left.runs), ("duplicate_clusters", left.clusters), ("duplicate_items", left.items)):
                    now[n, ""] = self._put(n, d)
        for n, d in zip(self.BY_RUN, (runs, clusters, items), strict=True):
            now[n, ids[0]] = self._put(n, d)
        self._point(now)


def list_watched(watched: DataFrame) -> DataFrame:
    return watched.orderBy("id")


def toggle_watched(watched: DataFrame, path_id: int, enabled: bool) -> DataFrame:
    """A watched path is switched on or off; an id that there is not changes nothing."""
    return watched.withColumn("enabled", F.when(F.col("id") == path_id, F.lit(enabled)).otherwise(F.col("enabled")))


def remove_watched(watched: DataFrame, path_id: int) -> DataFrame:
    return watched.where(F.col("id") != path_id)


def touch_watched(watched: DataFrame, at) -> DataFrame:
    """Enabled paths were scanned at ``at`` (a column or a time)."""
    at = at if isinstance(at, Column) else F.lit(at)
    return watched.withColumn("last_scanned_at", F.when(F.col("enabled"), at.cast("timestamp")).otherwise(F.col("last_scanned_at")))


def watch_sync(current: DataFrame, desired: DataFrame) -> DataFrame:
    """What to add to and remove from the watched paths."""
    add = desired.select("path").join(current.select("path"), "path", "left_anti").withColumn("op", F.lit("add"))
    return add.unionByName(current.select("path").join(desired.select("path"), "path", "left_anti").withColumn("op", F.lit("remove")))


def upsert_watched(current: DataFrame, added: DataFrame) -> DataFrame:
    """Added paths are enabled and take the new ``recursive``; known ones keep their id, new ones get the next."""
    known = current.join(added.select("path", F.col("recursive").alias("r")), "path", "left").withColumns({"enabled": F.col("enabled") | F.col("r").isNotNull(), "recursive": F.coalesce("r", "recursive")}).drop("r")
    new = added.join(current.select("path"), "path", "left_anti")
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).withColumn("j", F.lit(1))
    new = new.withColumn("j", F.lit(1)).join(top, "j").withColumn("id", F.col("top") + F.row_number().over(Window.partitionBy("j").orderBy("path")))
    return known.select("id", "path", "recursive", "enabled").unionByName(new.select("id", "path", "recursive", F.lit(True).alias("enabled")))
