"""Scans over time: the previous report, what is new, ranges of validity, and hash-chained logs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the link of a log's first entry.
GENESIS = "GENESIS"


def previous_reports(reports: DataFrame) -> DataFrame:
    """Each report with the latest one before it (by time, then id) of the same project."""
    w = Window.partitionBy("project").orderBy("scanned_at", "report_id")
    return reports.withColumn("previous_id", F.lag("report_id").over(w)).withColumn("previous_total", F.lag("total").over(w))


def new_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings of current without a counterpart in previous: by source path, or by target where previous has no path."""
    key = lambda c: [F.lower("rule_id").alias("k_rule"), F.lower("category").alias("k_category"), F.lower("domain").alias("k_domain"), F.col(c).alias("k_identity")]
    now = current.withColumn("own", F.coalesce("source_path", "target"))

    def without(rows: DataFrame, known: DataFrame, on: str) -> DataFrame:
        met = (F.lower("rule_id") == F.col("k_rule")) & (F.lower("category") == F.col("k_category")) & F.lower("domain").eqNullSafe(F.col("k_domain")) & (F.col(on) == F.col("k_identity"))
        return rows.join(known, met, "left_anti")

    by_path = previous.where("source_path IS NOT NULL").select(*key("source_path")).distinct()
    by_target = previous.where("source_path IS NULL").select(*key("target")).distinct()
    return without(without(now, by_path, "own"), by_target, "target").drop("own")


def within(rows: DataFrame, windows: DataFrame, at: str, lo: str, hi: str, on: list[str]) -> DataFrame:
    """Rows inside a validity window of the same key, bounds included."""
    return rows.join(windows, on).where(F.col(at).between(F.col(lo), F.col(hi)))


def entry_hash() -> F.Column:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sequence", "at", "probe_id", "target", "action", "outcome", "detail", "previous_hash")]
    return F.upper(F.sha2(F.concat_ws("|", *fields), 256))


def chain(rows: DataFrame, log: str = "log_id") -> DataFrame:
    """Build each log's hash chain. A link needs the one before it, so each log is read in order, a batch at a time; only the last hash is carried on."""
    import pyarrow as pa

    fields = ["sequence", "at", "probe_id", "target", "action", "outcome", "detail"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        current, previous, begun = None, GENESIS, False
        for batch in batches:
            links, hashes = [], []
            for name, *own in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if not begun or name != current:
                    current, previous, begun = name, GENESIS, True
                links.append(previous)
                previous = hashlib.sha256("|".join([*("" if v is None else str(v) for v in own), previous]).encode()).hexdigest().upper()
                hashes.append(previous)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.string()), pa.array(hashes, pa.string())], [log, *fields, "previous_hash", "hash"])

    wanted = rows.select(log, F.col("sequence").cast("long").alias("sequence"), *(F.col(c).cast("string").alias(c) for c in fields[1:]))
    kind = wanted.schema[log].dataType.simpleString()
    return wanted.repartition(log).sortWithinPartitions(log, "sequence").mapInArrow(build, f"{log} {kind}, sequence long, at string, probe_id string, target string, action string, outcome string, detail string, previous_hash string, hash string")


def verify_chain(entries: DataFrame, log: str = "log_id") -> DataFrame:
    """Per log: entries, and whether each links to the one before it and hashes to what is stored."""
    w = Window.partitionBy(log).orderBy("sequence")
    linked = F.col("previous_hash") == F.coalesce(F.lag("hash").over(w), F.lit(GENESIS))
    checked = entries.withColumn("linked", linked).withColumn("hashed", F.col("hash") == entry_hash())
    return checked.groupBy(log).agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("linked")).alias("broken_links"), F.count_if(~F.col("hashed")).alias("changed"), F.bool_and(F.col("linked") & F.col("hashed")).alias("intact"))
