"""Folder inventories by a data source whose partitions are folders: one that can't be read is a row, not a failure."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from govlens.operators.lexical import exclusion_reason

_ROW = "path string, folder string, length bigint, modified double, error string"


class _Folder(InputPartition):
    def __init__(self, path: str, whole: bool):
        self.path, self.whole = path, whole


class _Reader(DataSourceReader):
    def __init__(self, root: str, partitions: int):
        self.root, self.most = root, partitions

    def partitions(self) -> list[InputPartition]:
        """Folders level by level until there are enough of them; those above are listed without what lies below."""
        above, level = [], [self.root]
        while level and len(level) < self.most:
            below = []
            for folder in level:
                try:
                    below += sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False))
                except OSError:
                    continue  # its own partition says so
            if not below:
                break
            above, level = above + level, below
        return [_Folder(p, False) for p in above] + [_Folder(p, True) for p in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                yield None, folder, None, None, type(e).__name__
                continue
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if partition.whole:
                        todo.append(entry.path)
                    continue
                try:
                    known = entry.stat()
                    yield entry.path, folder, known.st_size, known.st_mtime, None
                except OSError as e:
                    yield entry.path, folder, None, None, type(e).__name__


class FolderSource(DataSource):
    """spark.read.format("folders").option("partitions", 64).load(root), on a file system that driver and executors mount."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return _ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitions", "64")))


def folder_inventory(spark: SparkSession, root: str, partitions: int = 64) -> DataFrame:
    """(path, folder, length, modified, error) of all files below root; a folder or file that can't be read has its error, the former no path."""
    spark.dataSource.register(FolderSource)
    rows = spark.read.format("folders").option("partitions", partitions).load(root)
    return rows.withColumn("modified", F.timestamp_seconds("modified"))


def discovery_diagnostics(inventory: DataFrame) -> DataFrame:
    """(kind, reason, n, affects_coverage): entries left out, by reason, and what couldn't be read, which makes a discovery incomplete."""
    reason = F.coalesce("error", exclusion_reason(F.coalesce("path", "folder")))
    kind = F.when(F.col("path").isNull(), "unreadable folder").when(F.col("error").isNotNull(), "unreadable file").when(reason.isNotNull(), "excluded").otherwise("analysed")
    rows = inventory.select(kind.alias("kind"), reason.alias("reason")).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("affects_coverage", F.startswith("kind", F.lit("unreadable")))
