"""Longest-processing-time sharding of groups that must stay together.

A heap over every group would pass the whole corpus through the driver, so the groups are split by size. Those larger
than 1/(fine * shards) of all bytes (fewer than fine * shards by count) are items of their own. The others fall, by a hash
of their key, into a fixed number of bundles whose sizes shrink by halves from level to level. Items and bundles, a number
that depends on shards alone, are sorted by size and go to the least-loaded shard through a heap on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import stored

#: A group of its own holds at least this part of a shard's even share.
FINE = 256
#: Bundles per shard on each of so many levels.
PER_LEVEL, LEVELS = 32, 8


def _bundle(key: Column, shards: int) -> Column:
    """The bundle of a small group: level l gets half as many bytes as level l - 1."""
    level = F.lit(LEVELS - 1)
    draw = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << LEVELS))
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(draw >= (1 << (LEVELS - 1 - k)), F.lit(k)).otherwise(level)
    return level * (PER_LEVEL * shards) + F.pmod(F.xxhash64(key, F.lit(2)), F.lit(PER_LEVEL * shards))


def longest_first(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Sorted by size, each item goes to the shard with the least load; ties go by name and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[name] = shard
    return out


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", overhead: int = 8, rows_per_block: int = 20_000) -> DataFrame:
    """Deal documents to shards with nearly equal bytes; equal texts stay together.

    Returns key, size (UTF-8 bytes of the text plus overhead), text_crc32, shard, slot (0, 1, ... in its shard). A null
    text is a group of its own kind with 0 bytes, apart from the empty text. Rows with equal keys are all kept; an empty
    table gives no rows. Only key and text are read.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    size = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + F.lit(overhead)
    rows = stored(docs.select(F.col(key).alias("key"), size.alias("size"), F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"), F.unhex(F.coalesce(F.md5(body.cast("binary")), F.lit(""))).alias("grp")))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(1, total // (FINE * shards))
    items = groups.withColumn("bundle", F.when(F.col("bytes") <= least, _bundle(F.col("grp"), shards)))
    loads = items.groupBy("bundle", F.when(F.col("bundle").isNull(), F.col("grp")).alias("own")).agg(F.sum("bytes").alias("bytes")).collect()  # at most FINE + PER_LEVEL * LEVELS rows a shard
    placed = longest_first([((r.bundle, bytes(r.own) if r.own is not None else None), r.bytes) for r in loads], shards)
    own = spark.createDataFrame([(bytearray(g), s) for (b, g), s in placed.items() if b is None], "grp binary, own_shard int")
    bundles = spark.createDataFrame([(b, s) for (b, _), s in placed.items() if b is not None], "bundle int, bundle_shard int")
    dealt = (
        rows.join(F.broadcast(own), "grp", "left")  # both tables are bounded by shards alone
        .withColumn("bundle", _bundle(F.col("grp"), shards).cast("int"))
        .join(F.broadcast(bundles), "bundle", "left")
        .withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
    )
    blocks = max(1, -(-n_rows // rows_per_block)) * 8
    dealt = stored(dealt.select("key", "size", "text_crc32", "shard", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(blocks)).cast("int").alias("block")))
    before = dealt.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "text_crc32"))
    out = dealt.withColumn("inside", inside).join(before, ["shard", "block"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"))
