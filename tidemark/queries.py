"""The engine's queries over the tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import exact, keepers, matchers, reports, similarity, store
from tidemark.plans import corpus
from tidemark.plans.session import ensure_checkpoints
from tidemark.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return exact.duplicate_records(corpus.files(spark, sf, content=True))


def _run_records(spark: SparkSession, sf: str) -> DataFrame:
    return exact.duplicate_records(corpus.runs(spark, sf), by=("run_id", "run_no"))


def _tables(spark: SparkSession, sf: str) -> store.RunTables:
    """The tables of the runs; records are written once, as several tables are made of them."""
    ensure_checkpoints(spark)
    r = _run_records(spark, sf).checkpoint()
    return store.RunTables(store.runs_of(corpus.runs(spark, sf), r), store.clusters_of(r), store.items_of(r))


def _deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Paths somebody asked to delete: those of documents whose id is divisible by 3."""
    return corpus.files(spark, sf).where("doc_id % 3 = 0").select("path")


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """An older index: some files unknown to it, some of another time, and some that are gone."""
    f = corpus.files(spark, sf, content=True).where("doc_id % 5 <> 0")
    path = F.when(F.col("doc_id") % 19 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path"))
    time = F.when(F.col("doc_id") % 7 == 0, F.col("modified_epoch") - 10).otherwise(F.col("modified_epoch"))
    return f.select(path.alias("path"), "size_bytes", time.alias("modified_epoch"), exact.quick_hash().alias("quick_hash"), F.lit(None).cast("string").alias("full_hash"), "category", F.lit("run_1").alias("last_seen_run"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as file changes: a view is a read, the others are changes."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    i = F.col("event_id")
    path = F.when(i % 10 == 0, "/vault/store/tidemark.db-wal").when(i % 10 == 1, F.concat(F.lit("/vault/.git/obj_"), i.cast("string"))).otherwise(F.concat(F.lit("/vault/f_"), i.cast("string")))
    paths = F.when(i % 25 == 3, F.array().cast("array<string>")).otherwise(F.array(path))
    kind = F.when(F.col("event_type") == "view", "access").otherwise("modify")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("event_ts"), "user_id", kind.alias("kind"), paths.alias("paths"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), similarity.bits(F.col("embedding")).alias("code"))


def _watched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Paths that are watched now, with ids, and paths that shall be."""
    s = corpus.documents(spark, sf).groupBy("source").agg(F.min("doc_id").alias("d"))
    path = F.concat(F.lit("/vault/"), F.col("source")).alias("path")
    now = s.where("d % 3 <> 0").select((F.col("d") + 1).alias("id"), path, F.lit(True).alias("recursive"), (F.col("d") % 2 == 0).alias("enabled"))
    return now, s.where("d % 4 <> 1").select(path, (F.col("d") % 5 == 0).alias("recursive"))


# sources and expressions


@query
def scan_classified(spark, sf):
    return corpus.files(spark, sf).select("path", "size_bytes", "modified_epoch", "is_media", "category")


@query
def scan_stats(spark, sf):
    return exact.scan_stats(corpus.files(spark, sf))


@query
def scan_catalog(spark, sf):
    """Files below the roots that are not below an excluded name."""
    d = corpus.documents(spark, sf).select(F.expr(corpus.NESTED_SQL.format(string="STRING")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"))
    return d.where(~X.is_excluded(F.col("path"), "/vault/") & (F.col("size_bytes") > 0))


@query
def excluded_paths(spark, sf):
    d = corpus.documents(spark, sf).select(F.expr(corpus.NESTED_SQL.format(string="STRING")).alias("path"))
    return d.where(X.is_excluded(F.col("path"), "/vault/"))


@query
def mime_type(spark, sf):
    p = F.col("path")
    return corpus.files(spark, sf).select("path", X.mime_type(X.extension(p)).alias("mime"))


@query
def media_candidates(spark, sf):
    f = corpus.files(spark, sf)
    return f.where(matchers.VisionMatcher().supported()).select("path", "category")


@query
def content_digest(spark, sf):
    return corpus.files(spark, sf, content=True).select("path", F.sha2("content", 256).alias("digest"))


@query
def quick_hash_head(spark, sf):
    return corpus.files(spark, sf, content=True).select("path", exact.quick_hash().alias("quick_hash"))


@query
def similarity_label(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    s = F.when(F.col("vec_id") % 10 == 0, F.lit(1.0)).otherwise((F.col("vec_id") % 200) / 200.0)
    return v.select("vec_id", X.similarity_label(s).alias("label"))


@query
def progress_pct(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", X.progress_pct(F.col("event_id"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.lit(5000))).alias("pct"))


@query
def drive_roots(spark, sf):
    d = corpus.documents(spark, sf).select("doc_id", F.expr("CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN concat('/mnt/', source) WHEN 2 THEN concat('/Volumes/', source) ELSE concat('/mnt/', source, '/x') END").alias("path"))
    return d.select("doc_id", "path", X.is_drive_root(F.col("path")).alias("is_root"))


@query
def size_round_trip(spark, sf):
    f = corpus.files(spark, sf)
    mb = X.size_mb(F.col("size_bytes"))
    return f.select("path", X.bytes_of_mb(mb).alias("bytes"), X.rounded(mb, 2).alias("mb"))


@query
def browse_directories(spark, sf):
    return reports.browse(corpus.files(spark, sf), "/vault")


@query
def manifest_explode(spark, sf):
    """Records read back from their JSON form."""
    r = _records(spark, sf)
    j = r.select(F.to_json(F.struct("group_id", "action", "category", "path")).alias("j"))
    return j.select(F.from_json("j", "group_id bigint, action string, category string, path string").alias("r")).select("r.*")


# exact duplicates


@query
def size_collisions(spark, sf):
    return exact.size_collisions(corpus.files(spark, sf)).select("path", "size_bytes", "n_same_size")


@query
def exact_clusters(spark, sf):
    m = exact.exact_members(corpus.files(spark, sf, content=True))
    return m.groupBy("size_bytes", "digest").agg(F.count(F.lit(1)).alias("n_members"), F.min("path").alias("first_path"))


@query
def funnel_clusters(spark, sf):
    m = exact.exact_members(corpus.files(spark, sf, content=True), funnel=True)
    return m.groupBy("size_bytes", "digest").agg(F.count(F.lit(1)).alias("n_members"), F.min("path").alias("first_path"))


@query
def keeper_scores(spark, sf):
    return corpus.files(spark, sf).select("path", X.keeper_score(F.col("path")).alias("score"))


@query
def keeper_choice(spark, sf):
    return exact.ranked_members(exact.exact_members(corpus.files(spark, sf, content=True))).select("path", "digest", "score", "rank", "action")


@query
def duplicate_records(spark, sf):
    return _records(spark, sf).drop("rank", "size_bytes", "member_no")


@query
def pipeline_records(spark, sf):
    """The same through the matcher pipeline, both tiers registered."""
    p = matchers.Pipeline().register(matchers.VisionMatcher()).register(matchers.ExactMatcher())
    return p.records(corpus.files(spark, sf, content=True)).select("group_id", "match_type", "action", "path")


@query
def tier2_candidates(spark, sf):
    f = corpus.files(spark, sf, content=True)
    return exact.prune_matched(f, exact.exact_members(f)).where("is_media").select("path", "category")


@query
def vision_clusters(spark, sf):
    """The visual tier at parity: no clusters."""
    return matchers.VisionMatcher().records(corpus.files(spark, sf)).select("group_id", "match_type", "path")


@query
def category_breakdown(spark, sf):
    return exact.category_breakdown(_records(spark, sf))


@query
def scan_summary(spark, sf):
    return exact.summary(corpus.files(spark, sf), _records(spark, sf))


@query
def summary_json(spark, sf):
    return reports.summary_json(exact.summary(corpus.files(spark, sf), _records(spark, sf)).select("total_files", "media_files", "exact_duplicate_groups", "wasted_bytes"))


@query
def table_sorted(spark, sf):
    """All records with their place by size, then name."""
    return reports.sorted_table(_records(spark, sf)).select("place", "path", "size_bytes", "action")


@query
def groups_ordered(spark, sf):
    """Groups with their members, the kept one first."""
    d = reports.ordered_groups(_records(spark, sf))
    return d.select("group_id", "n_members", F.to_json(F.transform("members", lambda m: m["path"])).alias("paths"))


@query
def newest_keeper(spark, sf):
    """Records where the file changed last is kept."""
    return exact.duplicate_records(corpus.files(spark, sf, content=True), keeper=keepers.NewestKeeper()).select("group_id", "path", "action")


@query
def progress_text(spark, sf):
    """Counts, names, rates and times as a terminal shows them."""
    f = corpus.files(spark, sf)
    return f.select(
        "path", X.with_thousands(F.col("size_bytes") * 1000).alias("bytes"), X.shortened(F.col("path"), 24).alias("short"),
        X.rate(F.col("size_bytes"), F.lit(2)).alias("rate"), X.clock(F.col("size_bytes") / 10).alias("clock"),
    )


# persisted runs


@query
def saved_clusters(spark, sf):
    return store.clusters_of(_run_records(spark, sf))


@query
def saved_items(spark, sf):
    return store.items_of(_run_records(spark, sf)).drop("dimensions")


@query
def run_history_top(spark, sf):
    t = _tables(spark, sf)
    return store.run_history(t.runs, 2).select("run_id", "total_files", "duplicate_groups", "wasted_bytes", "status")


@query
def latest_run(spark, sf):
    return store.latest_run(_tables(spark, sf).runs).select("run_id", "total_files", "duplicate_groups", "wasted_bytes")


@query
def clusters_with_items(spark, sf):
    t = _tables(spark, sf)
    d = store.clusters_with_items(t.clusters, t.items)
    return d.select("id", "run_id", "cluster_id", "category", F.size("items").alias("n_items"), F.to_json(F.transform("items", lambda x: x["path"])).alias("paths"))


@query
def cluster_page(spark, sf):
    return store.cluster_page(store.clusters_of(_run_records(spark, sf)), "run_3", offset=5, limit=10).select("id", "cluster_id", "category")


@query
def cluster_page_by_category(spark, sf):
    return store.cluster_page(store.clusters_of(_run_records(spark, sf)), "run_3", category="PHOTO", limit=10).select("id", "cluster_id", "category")


@query
def cluster_count(spark, sf):
    return store.clusters_of(_run_records(spark, sf)).groupBy("run_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query
def groups_by_match_type(spark, sf):
    return store.group_counts(store.clusters_of(_run_records(spark, sf)))


@query
def distinct_duplicate_paths(spark, sf):
    return store.items_of(_run_records(spark, sf)).where("action = 'DUPLICATE'").select("path").distinct()


@query
def keeper_override(spark, sf):
    """The second file of run 3's first cluster becomes the one to keep; all items afterwards."""
    items = store.items_of(_run_records(spark, sf))
    first = 3 * store.RUN_STRIDE + 1
    second = items.where(F.col("id") == first + 1).select("path").first()
    return store.override_keeper(items, first, second.path if second else "").select("id", "path", "action")


@query
def items_after_delete(spark, sf):
    return store.items_without(store.items_of(_run_records(spark, sf)), _deleted(spark, sf)).select("id", "path", "action")


@query
def freed_space(spark, sf):
    return store.freed_space(store.items_of(_run_records(spark, sf)), _deleted(spark, sf))


@query
def exhausted_clusters(spark, sf):
    t = _tables(spark, sf)
    return store.exhausted_clusters(t.clusters, store.items_without(t.items, _deleted(spark, sf))).select("id", "run_id")


@query
def recomputed_runs(spark, sf):
    t = _tables(spark, sf)
    return store.recomputed_runs(t.runs, t.clusters, store.items_without(t.items, _deleted(spark, sf))).select("run_id", "duplicate_groups", "wasted_bytes")


@query
def delete_cascade(spark, sf):
    t = store.remove_paths(_tables(spark, sf), _deleted(spark, sf))
    n = t.items.join(t.clusters.select(F.col("id").alias("cluster_id"), "run_id"), "cluster_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_items"))
    return t.runs.select("run_id", "duplicate_groups", "wasted_bytes").join(n, "run_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


@query
def prune_missing(spark, sf):
    disk = corpus.files(spark, sf).where("doc_id % 6 <> 0")
    return store.missing_paths(store.items_of(_run_records(spark, sf)), disk)


@query
def prune_cascade(spark, sf):
    """Runs after duplicates that are on disk no more have gone."""
    after, _ = store.prune(_tables(spark, sf), corpus.files(spark, sf).where("doc_id % 6 <> 0"))
    return after.runs.select("run_id", "duplicate_groups", "wasted_bytes")


@query
def prune_counts(spark, sf):
    return store.prune(_tables(spark, sf), corpus.files(spark, sf).where("doc_id % 6 <> 0"))[1]


@query
def runs_upsert(spark, sf):
    """Run rows after run 2 was written twice more: the later one counts."""
    runs = _tables(spark, sf).runs
    again = runs.where("run_id = 'run_2'").withColumn("status", F.lit("failed"))
    later = again.withColumns({"timestamp": F.col("timestamp") + F.expr("interval 1 hour"), "status": F.lit("repeated")})
    new = again.withColumns({"run_id": F.lit("run_4"), "status": F.lit("completed")})
    return store.upsert_runs(runs, again.unionByName(later).unionByName(new)).select("run_id", "total_files", "status")


@query
def items_added(spark, sf):
    """Items after records of the media files were added to the first cluster of run 1."""
    items = store.items_of(_run_records(spark, sf))
    r = corpus.files(spark, sf).where("is_media").select("path", F.lit("DUPLICATE").alias("action"), X.size_mb(F.col("size_bytes")).alias("size_mb"), F.lit(None).cast("string").alias("dimensions"))
    return store.add_items(items, store.RUN_STRIDE + 1, r).select("id", "cluster_id", "path", "size_bytes")


@query
def file_index_forget(spark, sf):
    f = corpus.files(spark, sf).where("doc_id = 1").select("path").first()
    return store.forget_file(_index(spark, sf), f.path if f else "").select("path", "last_seen_run")


@query
def file_index_lookup(spark, sf):
    f = corpus.files(spark, sf).where("doc_id = 1").select("path").first()
    return store.cached_file(_index(spark, sf), f.path if f else "").drop("full_hash")


@query
def cascade_delete_run(spark, sf):
    t, _ = store.delete_run(_tables(spark, sf), _index(spark, sf), "run_2")
    return t.clusters.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_clusters")).join(t.runs.select("run_id", "total_files"), "run_id")


@query
def index_after_run_delete(spark, sf):
    _, index = store.delete_run(_tables(spark, sf), _index(spark, sf), "run_1")
    return index.groupBy("last_seen_run").agg(F.count(F.lit(1)).alias("n"))


@query
def reloaded_summary(spark, sf):
    return store.reloaded_summary(_tables(spark, sf))


@query
def delta_changed_files(spark, sf):
    return store.delta(corpus.files(spark, sf), _index(spark, sf)).where("state in ('changed', 'new')").select("path", "state")


@query
def delta_unchanged_files(spark, sf):
    return store.delta(corpus.files(spark, sf), _index(spark, sf)).where("state = 'unchanged'").select("path")


@query
def delta_states(spark, sf):
    return store.delta(corpus.files(spark, sf), _index(spark, sf)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def file_index_upsert(spark, sf):
    new = corpus.files(spark, sf, content=True).where("doc_id % 2 = 0").select("path", "size_bytes", "modified_epoch", exact.quick_hash().alias("quick_hash"), F.lit(None).cast("string").alias("full_hash"), "category", F.lit("run_2").alias("last_seen_run"))
    return store.upsert(_index(spark, sf), new, "path").drop("full_hash")


@query
def file_index_after_run(spark, sf):
    f = corpus.files(spark, sf, content=True)
    return store.index_after_run(_index(spark, sf), f, "run_2", exact.quick_hash()).select("path", "modified_epoch", "last_seen_run")


@query
def watch_sync_plan(spark, sf):
    return store.watch_sync(*_watched(spark, sf))


@query
def watched_paths_upsert(spark, sf):
    return store.upsert_watched(*_watched(spark, sf))


@query
def watched_toggle(spark, sf):
    """Watched paths after the path of the least id was switched off."""
    now, _ = _watched(spark, sf)
    first = now.agg(F.min("id").alias("id")).first().id
    return store.toggle_watched(now, first if first is not None else 0, False)


@query
def watched_remove(spark, sf):
    now, _ = _watched(spark, sf)
    first = now.agg(F.min("id").alias("id")).first().id
    return store.remove_watched(now, first if first is not None else 0)


@query
def watched_touch(spark, sf):
    """Enabled paths were scanned; the others never were. In the order of ids."""
    now, _ = _watched(spark, sf)
    now = now.withColumn("last_scanned_at", F.lit(None).cast("timestamp"))
    d = store.list_watched(store.touch_watched(now, F.lit("2024-05-01 12:00:00")))
    return d.select("id", "path", "enabled", F.col("last_scanned_at").isNotNull().alias("scanned"))


# reports and plans


@query
def csv_report(spark, sf):
    return reports.csv_lines(_records(spark, sf)).select("line")


@query
def delete_script(spark, sf):
    return reports.script_lines(_records(spark, sf)).select("line")


@query
def keeper_map(spark, sf):
    return reports.keeper_map(_records(spark, sf)).select("path", "keeper")


@query
def clean_targets(spark, sf):
    return reports.clean_targets(_records(spark, sf)).select("path", "bytes")


@query
def clean_batches(spark, sf):
    return reports.clean_batches(reports.clean_targets(_records(spark, sf)), 10).select("path", "batch_no")


@query
def delete_plan_trash(spark, sf):
    return reports.delete_plan(_records(spark, sf), _deleted(spark, sf), "trash", "/vault")


@query
def delete_plan_permanent(spark, sf):
    return reports.delete_plan(_records(spark, sf), _deleted(spark, sf), "permanent")


@query
def delete_plan_hardlink(spark, sf):
    return reports.delete_plan(_records(spark, sf), _deleted(spark, sf), "hardlink")


@query
def quarantine_dry_run(spark, sf):
    return reports.quarantine_totals(_records(spark, sf))


@query
def trash_status(spark, sf):
    return reports.trash_status(corpus.files(spark, sf), ("trash", ".trash-1000"))


@query
def smart_clean_tracks(spark, sf):
    return reports.tracks(_records(spark, sf))


# events


@query
def relevant_events(spark, sf):
    return watch.relevant(_events(spark, sf)).select("event_id", "kind")


def _pauses(events: DataFrame) -> DataFrame:
    return events.where("event_id % 50 = 0").select(F.col("event_ts").alias("from_ts"), (F.col("event_ts") + F.expr("interval 60 seconds")).alias("to_ts"))


@query
def events_outside_pause(spark, sf):
    """Every fiftieth event starts a pause of a minute."""
    e = _events(spark, sf)
    return watch.outside_pauses(e, _pauses(e)).select("event_id")


@query
def sweeps_due(spark, sf):
    """A sweep is asked for with every tenth event: none in a pause, none within five seconds of a change."""
    e = _events(spark, sf)
    ticks = e.where("event_id % 10 = 7").select("event_id", (F.col("event_ts") + F.expr("interval 6 seconds")).alias("event_ts"))
    return watch.due_sweeps(ticks, e, "5 seconds", _pauses(e)).select("event_id")


@query
def debounce_sessions(spark, sf):
    return watch.debounce(_events(spark, sf), "60 seconds").select(F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n_events")


@query
def debounce_by_user(spark, sf):
    return watch.debounce(_events(spark, sf), "30 minutes", key="user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"))


@query
def sessions_by_gap(spark, sf):
    return watch.sessions_by_gap(_events(spark, sf), 1800, "user_id")


@query
def sweep_windows(spark, sf):
    return watch.sweeps(_events(spark, sf), "1 hour").select(F.col("sweep_ts").cast("timestamp_ntz").alias("sweep_ts"), "n_events")


# similarity


@query
def perceptual_bits(spark, sf):
    """All 64 bits of a signature, and how many are set."""
    return _vectors(spark, sf).select("id", F.bit_count("code").cast("int").alias("ones"), F.lpad(F.bin("code"), 64, "0").alias("bits"))


@query
def hamming_pairs(spark, sf):
    return similarity.hamming_pairs(_vectors(spark, sf), 19)


@query
def cosine_pairs(spark, sf):
    p = similarity.cosine_pairs(_vectors(spark, sf).select("id", "vec"), 0.4)
    return p.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def visual_clusters(spark, sf):
    ensure_checkpoints(spark)
    return similarity.hamming_clusters(_vectors(spark, sf), 19)
