"""Summaries of scans as JSON files, by path or by run."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import IoError, SerializationError, StoreError
from tidemark.schemas import RECORD

#: What a summary has to hold, besides groups.
FIELDS = ("total_files_scanned", "total_duplicate_groups", "wasted_gb", "duration_seconds")


def find_summary(path: str | None = None, run_id: str | None = None, history: str | None = None) -> str:
    """The summary's file: the path itself, or what a history file (rows of run_id and summary_json) names for the run.

    A history that is not there or not JSON names nothing.
    """
    if path is None and run_id is not None and history is not None:
        try:
            with open(history, encoding="utf-8") as f:
                runs = json.load(f)
            path = next((r.get("summary_json") for r in runs if isinstance(r, dict) and r.get("run_id") == run_id), None)
        except (OSError, ValueError):
            path = None
    if not isinstance(path, str) or not os.path.isfile(path):
        raise StoreError(f"no summary of {run_id or path!r}")
    return path


def load_summary(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
    except OSError as e:
        raise IoError(str(e)) from e
    except ValueError as e:
        raise SerializationError(f"{path} is not JSON: {e}") from e
    if not isinstance(d, dict) or any(k not in d for k in FIELDS):
        raise SerializationError(f"{path} is not a summary")
    paths = d.get("scanned_paths")
    return {**d, "scanned_paths": paths if isinstance(paths, list) else []}  # of another form: none


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """The duplicate records in a summary's groups, read by Spark: path may be any it can open, of one or many summaries."""
    raw = spark.read.schema(f"groups array<struct<records:array<{RECORD.simpleString()}>>>").json(path, multiLine=True)
    return raw.selectExpr("inline(flatten(transform(groups, g -> g.records)))")
