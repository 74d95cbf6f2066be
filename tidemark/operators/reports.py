"""Reports and plans over duplicate records. Plans are rows; nothing is moved until one is carried out on purpose."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.errors import IoError, SecurityError
from tidemark.functions import exprs as X

BATCH = 150
TRASH_DIR = ".tidemark_trash"
# Names, header and layout of the report are a format.
CSV_NAMES = {"EXACT_HASH": "ExactHash", "VISUAL_AI_NEAR_DUPLICATE": "VisualAiNearDuplicate", "CONTENT_NEAR_DUPLICATE": "ContentNearDuplicate"}
CSV_HEADER = "group_id,match_type,action,category,similarity,size_mb,path,dimensions"


def csv_lines(records: DataFrame) -> DataFrame:
    """``group_id, rank, line``: the report's lines below CSV_HEADER."""
    kind = F.create_map(*[F.lit(x) for kv in CSV_NAMES.items() for x in kv])[F.col("match_type")]
    line = F.concat_ws(",", F.col("group_id").cast("string"), kind, F.initcap("action"), F.initcap("category"), F.col("similarity"), F.format_string("%.2f", "size_mb"), X.csv_quoted(F.col("path")), X.csv_quoted(F.coalesce("dimensions", F.lit(""))))
    return records.select("group_id", "rank", line.alias("line"))


def script_lines(records: DataFrame, mode: str = "trash") -> DataFrame:
    """``group_id, rank, line``: a shell command for each duplicate."""
    path = X.shell_quoted(F.col("path"))
    line = F.concat(F.lit("mv "), path, F.lit(' "$TRASH_DIR/"')) if mode == "trash" else F.concat(F.lit("rm -f "), path)
    return records.where("action = 'DUPLICATE'").select("group_id", "rank", line.alias("line"))


def script_head(mode: str = "trash", base: str = ".") -> str:
    """What stands above the commands of a script."""
    lines = ["#!/usr/bin/env bash", "set -euo pipefail"]
    return "\n".join([*lines, f'TRASH_DIR="{base}/{TRASH_DIR}"', 'mkdir -p "$TRASH_DIR"'] if mode == "trash" else lines)


def write_lines(lines: DataFrame, path: str, head: str = "") -> None:
    """A report as one text file: the head, then the lines by (group_id, rank). Sorted in parallel, joined by one task."""
    spark = lines.sparkSession
    d = lines.orderBy("group_id", "rank").select(F.col("line").alias("value")).coalesce(1)

    def with_head(batches):
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    aside = f"{path}.{uuid.uuid4().hex}"
    d.mapInArrow(with_head, "value string").write.text(aside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    parts = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    fs.delete(target, True)
    if not (fs.rename(parts[0], target) if parts else fs.createNewFile(target)):
        raise IoError(f"{path} can't be written")
    fs.delete(folder, True)


def clean_targets(records: DataFrame, exact_only: bool = True) -> DataFrame:
    d = records.where("action = 'DUPLICATE'")
    d = d.where("match_type = 'EXACT_HASH'") if exact_only else d
    return d.select("group_id", "rank", "path", F.floor(F.col("size_mb") * X.MB).cast("long").alias("bytes"))


def clean_batches(targets: DataFrame, size: int = BATCH) -> DataFrame:
    """Targets with the number of their batch.

    The order is (group, rank). Places come from counts by group, then within a group, so only
    one row a group meets in one task.
    """
    per = targets.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("group_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    k = F.row_number().over(Window.partitionBy("group_id").orderBy("rank"))
    return targets.withColumn("k", k).join(per, "group_id").select("group_id", "rank", "path", "bytes", F.floor((F.col("first") + F.col("k") - 1) / size).cast("long").alias("batch_no"))


def keeper_map(records: DataFrame) -> DataFrame:
    """Each duplicate with the file that is kept in its place."""
    keep = records.where("action = 'KEEP'").select("group_id", F.col("path").alias("keeper"))
    return records.where("action = 'DUPLICATE'").select("group_id", "path", "size_bytes").join(keep, "group_id")


def delete_plan(records: DataFrame, paths: DataFrame, mode: str, base: str = ".") -> DataFrame:
    """``op, src, dst, size_bytes`` for asked-for paths. Files that are kept never get into a plan.

    Names that meet in the trash are told apart by a number.
    """
    ask = keeper_map(records).join(paths.select("path").distinct(), "path", "left_semi")
    if mode == "hardlink":
        return ask.select(F.lit("hardlink").alias("op"), F.col("path").alias("src"), F.col("keeper").alias("dst"), "size_bytes")
    if mode == "permanent":
        return ask.select(F.lit("permanent").alias("op"), F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), "size_bytes")
    name = X.file_name(F.col("path"))
    k = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    dot = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1)
    tail = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 2)
    unique = F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(dot, F.lit("_"), (F.col("k") - 1).cast("string"), tail))
    d = ask.withColumn("name", name).withColumn("k", k)
    return d.select(F.lit("trash").alias("op"), F.col("path").alias("src"), F.concat(F.lit(f"{base}/{TRASH_DIR}/"), unique).alias("dst"), "size_bytes")


def quarantine_totals(records: DataFrame) -> DataFrame:
    return records.where("action = 'DUPLICATE'").agg(F.count(F.lit(1)).alias("total_files_moved"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes_moved"), F.lit(True).alias("dry_run"))


def carry_out(plan: DataFrame, keepers: DataFrame) -> tuple[int, int]:
    """Carry a plan out on this machine's files; the number of files and bytes it freed. A plan that touches a keeper is refused."""
    if not plan.join(keepers.select(F.col("path").alias("src")), "src", "left_semi").isEmpty():
        raise SecurityError("the plan touches a file that is kept")
    done = freed = 0
    for row in plan.toLocalIterator():
        try:
            size = os.stat(row.src).st_size
            if row.op == "permanent":
                os.remove(row.src)
            elif row.op == "trash":
                os.makedirs(os.path.dirname(row.dst), exist_ok=True)
                shutil.move(row.src, row.dst)
            else:
                os.link(row.dst, row.src + ".tidemark_tmp")
                os.replace(row.src + ".tidemark_tmp", row.src)
        except OSError:
            continue
        done, freed = done + 1, freed + size
    return done, freed


def trash_status(catalog: DataFrame, folders: Iterable[str] = (TRASH_DIR,)) -> DataFrame:
    """Files and bytes that stand directly in a folder of one of those names."""
    parent = F.expr("regexp_replace(path, '/[^/]*$', '')")
    d = catalog.withColumn("dir", parent).where(F.element_at(F.split("dir", "/"), -1).isin(*folders))
    return d.agg(F.count(F.lit(1)).alias("items_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"), F.countDistinct("dir").alias("trash_dirs"))


def empty_trash(roots: Iterable[str]) -> tuple[int, int]:
    """Delete the files that stand directly in the trash folder of each root, on this machine; how many, and their bytes. Folders in it stay."""
    done = freed = 0
    for folder in sorted({os.path.join(r, TRASH_DIR) for r in roots}):
        if not os.path.isdir(folder):
            continue
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_file(follow_symlinks=False):
                        size = e.stat(follow_symlinks=False).st_size
                        os.remove(e.path)
                        done, freed = done + 1, freed + size
                except OSError:
                    continue
    return done, freed


def ordered_groups(records: DataFrame) -> DataFrame:
    """One row a group, in order, its members as a list: the kept one first, then by path."""
    member = F.struct((F.col("action") != "KEEP").alias("later"), "path", "action", "size_mb")
    d = records.groupBy("group_id", "match_type").agg(F.sort_array(F.collect_list(member)).alias("members"), F.count(F.lit(1)).alias("n_members"))
    return d.orderBy("group_id")


def sorted_table(records: DataFrame) -> DataFrame:
    """Records with ``place`` in the order (size descending, name without case, path), from 1.

    Places come from counts by size, so only one row a size meets in one task.
    """
    d = records.withColumn("name", F.lower(X.file_name(F.col("path"))))
    sizes = d.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.desc("size_bytes")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("size_bytes", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    k = F.row_number().over(Window.partitionBy("size_bytes").orderBy("name", "path"))
    return d.withColumn("k", k).join(sizes, "size_bytes").withColumn("place", F.col("first") + F.col("k")).drop("k", "first")


def browse(catalog: DataFrame, parent: str, limit: int = 300) -> DataFrame:
    """Sub-folders of a folder, those that start with a dot left out, and whether they have sub-folders."""
    below = catalog.where(F.col("path").startswith(parent + "/")).select(F.split(F.substr("path", F.lit(len(parent) + 2)), "/").alias("p")).where("size(p) > 1")
    d = below.select(F.col("p")[0].alias("name"), (F.size("p") > 2).alias("deep")).where("not startswith(name, '.')").groupBy("name").agg(F.max("deep").alias("has_children"))
    return d.orderBy(F.lower("name"), "name").limit(limit)


def tracks(records: DataFrame) -> DataFrame:
    """Exact and similar duplicates: files, groups and bytes."""
    t = F.when(F.col("match_type") == "EXACT_HASH", "exact").otherwise("similar")
    return records.where("action = 'DUPLICATE'").groupBy(t.alias("track")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("group_id").alias("groups"), F.sum("size_bytes").alias("bytes"))


def summary_json(summary: DataFrame) -> DataFrame:
    """The summary as one JSON object; report paths that there are not are ''."""
    return summary.select(F.to_json(F.struct(*summary.columns, F.lit("").alias("csv_report"), F.lit("").alias("quarantine_script"))).alias("json"))
