"""Schemas of the persisted tables."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType


def _schema(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


CATALOG = _schema(path=StringType(), size_bytes=LongType(), modified_epoch=LongType(), is_media=BooleanType(), category=StringType())
RECORD = _schema(group_id=LongType(), match_type=StringType(), action=StringType(), category=StringType(), similarity=StringType(), similarity_score=DoubleType(), size_mb=DoubleType(), path=StringType(), dimensions=StringType())
WATCHED_PATHS = _schema(id=LongType(), path=StringType(), recursive=BooleanType(), enabled=BooleanType(), last_scanned_at=TimestampType(), created_at=TimestampType())
SCAN_RUNS = _schema(run_id=StringType(), timestamp=TimestampType(), scanned_paths=ArrayType(StringType()), total_files=LongType(), duplicate_groups=LongType(), wasted_bytes=LongType(), duration_seconds=DoubleType(), status=StringType())
FILE_INDEX = _schema(path=StringType(), size_bytes=LongType(), modified_epoch=LongType(), quick_hash=StringType(), full_hash=StringType(), category=StringType(), last_seen_run=StringType())
CLUSTERS = _schema(id=LongType(), run_id=StringType(), cluster_id=LongType(), match_type=StringType(), category=StringType(), similarity_score=DoubleType())
ITEMS = _schema(id=LongType(), cluster_id=LongType(), path=StringType(), action=StringType(), size_bytes=LongType(), dimensions=StringType())
TABLES = {"watched_paths": WATCHED_PATHS, "scan_runs": SCAN_RUNS, "file_index": FILE_INDEX, "duplicate_clusters": CLUSTERS, "duplicate_items": ITEMS}
