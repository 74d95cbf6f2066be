"""Shared pieces: table access, durable intermediates and Arrow mapping."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One Arrow batch handed to a Python worker stays under this size, so that long
#: documents do not add up to more than a worker can hold.
ARROW_BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, whatever the rows hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, in local mode, one of our own where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Stash:
    """Intermediate tables written to the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks it ran,
    not the stages before. ``drop`` removes what nothing reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, *names: str) -> None:
        """Delete all tables but these: those that the result reads, which is evaluated later."""
        root, fs = self._at(self.root)
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        self.drop(*[n for n in found if n not in names])

    def drop(self, *names: str) -> None:
        """Delete tables, and let the context clean the shuffle files of jobs that are over."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p, fs = self._at(self.path(name))
            fs.delete(p, True)
        gc.collect()
        jvm.System.gc()


def once(column: Column) -> Column:
    """The column, so marked that a filter on it stays above it.

    The optimizer moves filters below projections by writing out what a column stands for; a
    filter on a column of many nested steps would repeat all of them, each several times over.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that workers can import it wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidemark", os.path.relpath(full, home)))
    sc.addPyFile(archive)
    sc._tidemark_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
