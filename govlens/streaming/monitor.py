"""Continuous monitoring with Structured Streaming: evaluate each micro-batch, windows over event time, chained logs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from govlens.operators.history import GENESIS


def signal_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def monitor(signals: DataFrame, evaluate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Append the findings of every micro-batch to out. A batch that is run again replaces its own folder, so none counts twice."""

    def keep(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = signals.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def tumbling(signals: DataFrame, at: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window of event time; rows later than the watermark are dropped."""
    found = signals.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("opened"), by, "n")


def sessions(signals: DataFrame, at: str = "ts", by: str = "user_id", gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    found = signals.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n")


def chained_log(entries: DataFrame) -> DataFrame:
    """(log_id, message) to a hash chain per log, which goes on over micro-batches: the state is its last number and hash."""

    def extend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, previous = state.get if state.exists else (0, GENESIS)
        rows = []
        for message in sorted(m for pdf in batches for m in pdf["message"]):
            number += 1
            digest = hashlib.sha256(f"{number}|{message}|{previous}".encode()).hexdigest().upper()
            rows.append((key[0], number, message, previous, digest))
            previous = digest
        state.update((number, previous))
        yield pd.DataFrame(rows, columns=["log_id", "sequence", "message", "previous_hash", "hash"])

    return entries.groupBy("log_id").applyInPandasWithState(extend, "log_id long, sequence long, message string, previous_hash string, hash string", "number long, previous string", "append", GroupStateTimeout.NoTimeout)
