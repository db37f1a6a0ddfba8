"""Tables between rounds of an iteration: written once to the shared folder and read back, which cuts lineage and survives lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """df as a table in spark.checkpoint.dir, kept until the program ends; only a local master may do without that setting."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{shared or os.path.join(tempfile.gettempdir(), 'govlens-shared')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_remove)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    """Delete the tables; where the session has ended already they stay for the owner of the shared folder."""
    for spark, path in _tables:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except (PySparkException, AttributeError, OSError, AssertionError):
            return
