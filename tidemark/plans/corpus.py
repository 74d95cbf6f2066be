"""The file corpus that the queries run over: each document is a file whose name follows from its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.crawl import classify

PATH_SQL = """concat('/vault/', source, CASE doc_id % 11 WHEN 3 THEN '/trash/' WHEN 5 THEN '/.trash-1000/' WHEN 8 THEN '/album-b/' ELSE '/' END,
 CASE doc_id % 13 WHEN 1 THEN 'copy of ' WHEN 2 THEN 'thumb_' ELSE '' END, 'doc_', CAST(doc_id AS {string}),
 CASE doc_id % 7 WHEN 1 THEN ' - Copy' WHEN 2 THEN '_edited' WHEN 4 THEN '_copy' ELSE '' END,
 CASE doc_id % 10 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' WHEN 3 THEN '.txt' WHEN 4 THEN '.gif' WHEN 5 THEN '.heic' WHEN 6 THEN '' WHEN 7 THEN '.ts' WHEN 8 THEN '.mov' ELSE '.pdf' END)"""
#: Path of the same file in a tree with excluded folders.
NESTED_SQL = "concat('/vault/', source, CASE doc_id % 17 WHEN 4 THEN '/node_modules' WHEN 9 THEN '/.git/objects' WHEN 12 THEN '/venv2' ELSE '' END, '/doc_', CAST(doc_id AS {string}), '.jpg')"
RUNS = (1, 2, 3)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """``doc_id, path, size_bytes, modified_epoch, is_media, category`` and, if asked for, ``content``."""
    cols = ["doc_id", F.expr(PATH_SQL.format(string="STRING")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), (F.lit(1700000000) + F.col("doc_id") * 60).alias("modified_epoch")]
    return classify(documents(spark, sf_dir).select(*cols, *([F.col("text").alias("content")] if content else [])))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as three scans saw it: scan k met the files whose id leaves at most k when divided by 4."""
    f = files(spark, sf_dir, content=True)
    seen = F.array(*[F.when(F.col("doc_id") % 4 <= k, F.lit(k).cast("long")) for k in RUNS])
    return f.withColumn("run_no", F.explode(F.filter(seen, lambda k: k.isNotNull()))).withColumn("run_id", F.concat(F.lit("run_"), F.col("run_no").cast("string")))
