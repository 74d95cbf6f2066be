"""A data source that lists the files below one or more roots.

Partitions are the roots' sub-folders, so a wide tree is walked by many tasks. Excluded
names are pruned before they are entered; links, empty files and unreadable entries are
left out; a missing root is an error before anything is listed.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.functions import exprs as X


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], recursive: bool, excluded: frozenset[str]):
        self.roots, self.recursive, self.excluded = roots, recursive, excluded

    def partitions(self) -> list[_Folder]:
        out = []
        for root in self.roots:
            out.append(_Folder(root, False))
            if self.recursive:
                with os.scandir(root) as entries:
                    out += [_Folder(e.path, True) for e in entries if e.is_dir(follow_symlinks=False) and e.name not in self.excluded]
        return out

    def read(self, partition: _Folder) -> Iterator[tuple]:
        stack = [partition.path]
        while stack:
            try:
                entries = list(os.scandir(stack.pop()))
            except OSError:
                continue
            for e in entries:
                try:
                    if e.name in self.excluded or e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep:
                            stack.append(e.path)
                    elif e.is_file(follow_symlinks=False) and (s := e.stat(follow_symlinks=False)).st_size:
                        yield e.path, s.st_size, max(0, int(s.st_mtime))
                except OSError:
                    continue


class _Changed(InputPartition):
    def __init__(self, folder: _Folder, after: int, until: int):
        super().__init__((folder.path, after, until))
        self.folder, self.after, self.until = folder, after, until


class _StreamReader(DataSourceStreamReader):
    """Files by time of change: a batch holds what changed since the last one, a second once it is over. Folders are read by tasks."""

    def __init__(self, files: _Reader):
        self.files = files

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int(time.time()) - 1}

    def partitions(self, start: dict, end: dict) -> list[_Changed]:
        return [_Changed(f, start["until"], end["until"]) for f in self.files.partitions()]

    def read(self, partition: _Changed) -> Iterator[tuple]:
        return (row for row in self.files.read(partition.folder) if partition.after < row[2] <= partition.until)


class CrawlSource(DataSource):
    """Options: roots (separated by line feeds), recursive, extra_excluded (separated by line feeds)."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "path string, size_bytes bigint, modified_epoch bigint"

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.reader(schema))

    def reader(self, schema) -> _Reader:
        roots = [r for r in self.options.get("roots", "").split("\n") if r]
        for r in roots:
            if not os.path.exists(r):
                raise FileNotFoundError(r)
        extra = [x for x in self.options.get("extra_excluded", "").split("\n") if x]
        return _Reader(roots, self.options.get("recursive", "true") == "true", frozenset([*X.EXCLUDED_NAMES, *extra]))


def scan_files(spark: SparkSession, roots: list[str], recursive: bool = True, extra_excluded: tuple[str, ...] = ()) -> DataFrame:
    """The catalog of files below the roots; a file below two of them is listed once."""
    for r in roots:
        if not os.path.exists(r):
            raise FileNotFoundError(r)
    spark.dataSource.register(CrawlSource)
    raw = spark.read.format("crawl").options(roots="\n".join(roots), recursive=str(recursive).lower(), extra_excluded="\n".join(extra_excluded)).load()
    return classify(raw.dropDuplicates(["path"]))


def stream_files(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """New and changed files below the roots, as a stream of catalog rows. A file changed again comes again; one below two roots comes twice."""
    for r in roots:
        if not os.path.exists(r):
            raise FileNotFoundError(r)
    spark.dataSource.register(CrawlSource)
    return classify(spark.readStream.format("crawl").options(roots="\n".join(roots), recursive=str(recursive).lower()).load())


def classify(files: DataFrame) -> DataFrame:
    """Add ``is_media`` and ``category``; empty files go."""
    ext = X.extension(F.col("path"))
    return files.where("size_bytes > 0").withColumns({"is_media": X.is_image(ext) | X.is_video(ext), "category": X.category(ext)})


def with_content(catalog: DataFrame) -> DataFrame:
    """Add ``content`` by one binary read of the listed files; unreadable ones go. Call it on candidates only."""

    def read(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    with open(p, "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield pdf.assign(content=pd.Series(out, dtype=object, index=pdf.index))

    return catalog.mapInPandas(read, StructType([*catalog.schema.fields]).add("content", "binary")).where("content is not null")
