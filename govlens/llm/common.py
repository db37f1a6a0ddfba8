"""What the operators of this subpackage share: tables, intermediate results, byte-sized batches, hashing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once by one Arrow function, in bytes.
BATCH_BYTES = 1 << 20
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master without one uses the temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or os.path.join(tempfile.gettempdir(), "govlens-shared")


def stored(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/govlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """The name, or with underscores behind it where columns has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _forget() -> None:
    """Delete what stored wrote; a folder that can't be deleted any more is left to the owner of the shared one."""
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:
            continue


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that column holds about limit bytes in each; one longer value stays alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes + 16)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins in them; null is empty."""
    array = array.fill_null("") if array.null_count else array
    wide = array.type in (pa.large_string(), pa.large_binary())
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ROOT = np.uint64(0x9E3779B97F4A7C15)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = ROOT) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) <= n:
        known = np.empty(n + 1, np.uint64)
        known[0] = 1
        np.multiply.accumulate(np.full(n, base, np.uint64), out=known[1:])
        if n <= 2 * BATCH_BYTES:
            _powers[int(base)] = known
    return known[: n + 1]


INVERSE = np.uint64(pow(int(ROOT), -1, 1 << 64))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span, from one running sum: equal contents, equal hashes."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n)[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers(n, INVERSE)[starts] + (ends - starts).astype(np.uint64))


def arrow_bounds(spark: SparkSession) -> None:
    """Let Arrow batches end by bytes, so that long texts do not gather in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
