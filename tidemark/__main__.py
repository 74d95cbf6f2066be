"""Command line: scan folders, show or clean what a warehouse holds, or follow its watched paths."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.operators import exact, reports, store
from tidemark.sources import crawl
from tidemark.streaming.watch import Watcher


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--warehouse", default="./tidemark-warehouse", help="folder of the persisted tables")
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="find duplicate files below folders and save the run")
    scan.add_argument("paths", nargs="+")
    scan.add_argument("--report", help="write a CSV report there")
    sub.add_parser("status", help="the latest run")
    clean = sub.add_parser("clean", help="take away the duplicates of the latest run; files that are kept stay")
    clean.add_argument("--mode", choices=("trash", "permanent", "hardlink"), default="trash")
    clean.add_argument("--base", default=".")
    watch = sub.add_parser("watch", help="watch folders and scan them")
    watch.add_argument("paths", nargs="*")
    sub.add_parser("prune", help="forget duplicates that are on disk no more").add_argument("paths", nargs="+")
    return p


def tables(w: store.Warehouse) -> store.RunTables:
    return store.RunTables(w.read("scan_runs"), w.read("duplicate_clusters"), w.read("duplicate_items"))


def records_of(w: store.Warehouse, run_id: str):
    """Saved items of a run as records."""
    c = w.read("duplicate_clusters").where(F.col("run_id") == run_id).select(F.col("id").alias("cluster_id"), F.col("cluster_id").alias("group_id"), "match_type")
    return w.read("duplicate_items").join(c, "cluster_id").select("group_id", "match_type", "action", "path", "size_bytes", (F.col("size_bytes") / 1048576).alias("size_mb"), F.col("id").alias("rank"))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    w = store.Warehouse(spark, a.warehouse)
    try:
        if a.command in ("scan", "watch"):
            now = w.read("watched_paths")
            if a.paths:
                asked = spark.createDataFrame([(p, True) for p in a.paths], "path string, recursive boolean")
                merged = store.upsert_watched(now.select("id", "path", "recursive", "enabled"), asked)
                if a.command == "scan":  # these and no others
                    merged = merged.withColumn("enabled", F.col("path").isin(*a.paths))
                old = now.select("id", "last_scanned_at", "created_at")
                w.write(watched_paths=merged.join(old, "id", "left").withColumn("created_at", F.coalesce("created_at", F.current_timestamp())))
            run_id = Watcher(spark, w, progress=lambda stage, done, total: print(f"{stage} {done}/{total}", file=sys.stderr)).cycle()
            if run_id and getattr(a, "report", None):
                catalog = crawl.with_content(crawl.scan_files(spark, a.paths))
                reports.write_lines(reports.csv_lines(exact.duplicate_records(catalog)), a.report, reports.CSV_HEADER)
        if a.command == "clean":
            latest = store.latest_run(w.read("scan_runs")).first()
            if latest is not None and latest.run_id is not None:
                r = records_of(w, latest.run_id)
                plan = reports.delete_plan(r, r.where("action = 'DUPLICATE'").select("path"), a.mode, a.base)
                done, freed = reports.carry_out(plan, r.where("action = 'KEEP'").select("path"))
                print(json.dumps({"files": done, "bytes": freed}))
        if a.command == "prune":
            after, counts = store.prune(tables(w), crawl.scan_files(spark, a.paths))
            row = counts.first()
            w.write(scan_runs=after.runs, duplicate_clusters=after.clusters, duplicate_items=after.items)
            print(json.dumps({"files": row.removed, "bytes": row.freed_bytes}))
        latest = store.latest_run(w.read("scan_runs")).select("run_id", "total_files", "duplicate_groups", "wasted_bytes", "status").first()
        print(json.dumps(latest.asDict() if latest is not None and latest.run_id is not None else {"status": "none"}))
        return 0
    except (EngineError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
