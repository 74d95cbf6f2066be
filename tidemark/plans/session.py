"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from tidemark.errors import ConfigError


def ensure_checkpoints(spark: SparkSession) -> None:
    """Where no folder for checkpoints is named, as in tests, set one of our own; a cluster has to name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ConfigError("spark.checkpoint.dir names no folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
