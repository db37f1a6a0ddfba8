"""Quality selection by importance resampling.

Two generative models over hashed n-grams are fitted: one of the target (labelled rows of good quality that are not toxic),
one of the raw corpus (every document). A document's importance weight is the ratio of the two, and the documents to keep
are sampled without replacement by Gumbel top-k. k is the number of documents whose weight reaches a level calibrated on
labelled rows that the target model didn't see, and at most 1: what the target makes no less likely than the raw corpus is
never below the level, however few labels calibrate it.

The n-grams are single tokens and pairs, and single ones and triples of the tokens' shapes (their case and digits, symbols
as they are, and whether a word repeats the one or two before it). Shapes are few, so few labels tell of them.

Buckets count documents, not occurrences, so one repetitive text can't bend a model. A bucket whose target count lies within
so many standard deviations of what the raw model expects, or within a factor exp(MIN_RATIO), says nothing (weight 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes, mix, spans_hash, stored, utf8
from govlens.llm.decontamination import _IS_WORD, grams

#: At most so many labelled rows are used; corpus counts always cover every document.
MAX_LABELLED = 30_000
#: Runs of tokens and of shapes that are counted.
TOKEN_ORDERS, SHAPE_ORDERS = (1, 2), (1, 3)
#: Tokens and runs of them have 2**BITS buckets for each order, shapes 2**SHAPE_BITS; a partition's counts are no more than
#: its buckets.
BITS, SHAPE_BITS = 20, 16
#: Standard deviations that count as noise: of each order of tokens, the more the more there are, and of shapes.
TOKEN_Z, SHAPE_Z = (2.5, 7.0), 1.3
MIN_RATIO, PRIOR = 0.7, 0.5
#: The part of the good held-out documents that the level may lose.
MOST_LOST = 0.01

_CLASS = np.where(_IS_WORD, 1, 2).astype(np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_VALUE = mix(np.arange(256).astype(np.uint64) + np.uint64(104729))
_BYTE = np.arange(256)
#: Bits of a word's shape: small letters (and all that isn't ASCII), capitals, digits.
_FLAGS = (((_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)) * 1 + ((_BYTE >= 65) & (_BYTE <= 90)) * 2 + ((_BYTE >= 48) & (_BYTE <= 57)) * 4).astype(np.uint8)


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, token: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of each token's shape."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    word = _CLASS[raw[starts]] == 1
    case = np.bitwise_or.reduceat(_FLAGS[raw], starts) | ((_FLAGS[raw[starts]] & 2) << 2)
    again = np.zeros(len(token), np.uint64)
    for k in (2, 1):
        again[k:][(token[k:] == token[:-k]) & (owner[k:] == owner[:-k]) & word[k:]] = k
    symbol = spans_hash(_VALUE[raw], starts, np.minimum(ends, starts + 3))
    return mix(np.where(word, mix(case.astype(np.uint64)), symbol) + again)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each n-gram. Tokens are runs of letters and digits, or of other visible characters."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[raw]
    new = np.ones(n + 1, bool)
    new[1:n] = kind[1:] != kind[:-1]
    new[offsets] = True
    edges = np.flatnonzero(new)
    seen = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][seen], edges[1:][seen]
    token = spans_hash(_VALUE[raw], starts, ends)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    texts, buckets = [], []
    kinds = [(token, k, i << bits, bits) for i, k in enumerate(TOKEN_ORDERS)]
    shapes = _shapes(raw, starts, ends, token, owner)
    kinds += [(shapes, k, len(TOKEN_ORDERS) << bits, SHAPE_BITS) for k in SHAPE_ORDERS]
    for values, k, first, width in kinds:
        if len(values) >= k:
            h = grams(values, k)
            own = owner[: len(h)]
            inside = own == owner[k - 1 :]
            texts.append(own[inside])
            buckets.append(first + (h[inside] & np.uint64((1 << width) - 1)).astype(np.int64))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(texts or none), np.concatenate(buckets or none)


def n_buckets(bits: int) -> int:
    return (len(TOKEN_ORDERS) << bits) + (1 << SHAPE_BITS)


def bucket_counts(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Over all documents (text, is_target): documents and target documents with an n-gram in each bucket; bucket -1: all."""
    every = n_buckets(bits)
    wide = every.bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, every + 1), np.int32)  # documents of one partition
        for batch in by_bytes(batches, "text"):
            target = np.asarray(batch.column("is_target"))
            text, bucket = features(*utf8(batch.column("text")), bits)
            pairs = np.unique((text << wide) | bucket)
            bucket = pairs & ((1 << wide) - 1)
            np.add.at(total[0], bucket, 1)
            np.add.at(total[1], bucket[target[pairs >> wide]], 1)
            total[:, -1] += (batch.num_rows, int(target.sum()))
        at = np.flatnonzero(total[0])
        for part in np.array_split(at, len(at) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(np.where(part == every, -1, part).astype(np.int32)), *(pa.array(t[part].astype(np.int64)) for t in total)], ["bucket", "n_raw", "n_target"])

    return docs.mapInArrow(count, "bucket int, n_raw long, n_target long").groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def log_ratios(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """ln(target / raw) of each bucket from its counts; only those that say something come to the driver."""
    out = np.zeros(n_buckets(bits), np.float32)
    totals = counts.where("bucket = -1").first()
    if totals is None or not totals.n_target:
        return out
    share = totals.n_target / totals.n_raw
    expected = F.col("n_raw") * F.lit(share)
    ratio = F.log((F.col("n_target") + F.lit(PRIOR)) / (expected + F.lit(PRIOR)))
    z = F.try_element_at(F.array(*map(F.lit, TOKEN_Z)), F.shiftright("bucket", bits) + 1)
    noise = F.coalesce(z, F.lit(SHAPE_Z)) * F.sqrt(expected * F.lit(1 - share))
    told = counts.where("bucket >= 0").where((F.abs(F.col("n_target") - expected) >= noise) & (F.abs(ratio) >= MIN_RATIO))
    found = told.select("bucket", ratio.alias("ratio")).toArrow()  # at most one row a bucket
    out[np.asarray(found["bucket"].combine_chunks())] = np.asarray(found["ratio"].combine_chunks())
    return out


def log_weights(docs: DataFrame, ratios: np.ndarray, bits: int = BITS) -> DataFrame:
    """(key, log_weight, n_grams) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)  # 4 bytes a bucket: 9 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            text, bucket = features(*utf8(batch.column("text")), bits)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.bincount(text, sent.value[bucket], minlength=n).astype(float)), pa.array(np.bincount(text, minlength=n))], ["key", "log_weight", "n_grams"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(score, f"key {kind}, log_weight double, n_grams long")


def level(scores: np.ndarray, good: np.ndarray) -> float:
    """The middle of the levels that best tell good from bad by balanced accuracy, and lose MOST_LOST of the good at most; 0 if one kind is missing."""
    if not len(good) or good.all() or not good.any():
        return 0.0
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    rejected_good = np.concatenate(([0], np.cumsum(g)))
    rejected_bad = np.concatenate(([0], np.cumsum(~g)))
    cuts = np.flatnonzero(np.concatenate(([True], s[1:] > s[:-1])))
    cuts = cuts[rejected_good[cuts] <= MOST_LOST * g.sum()]
    balance = rejected_bad[cuts] / (~g).sum() - rejected_good[cuts] / g.sum()
    best = cuts[int(np.argmax(balance))]
    return float((s[best] + s[best - 1]) / 2) if best else float(s[0])


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, last: int = 10_000) -> float:
    """The k-th largest value of a column of finite doubles, by counting in ever narrower bins."""
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return lo
    while hi > lo and n > last:
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        found = sorted(rows.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r.bin)
        for r in found:
            if r.n >= k:
                lo, hi, n = r.lo, r.hi, r.n
                break
            k -= r.n
    if hi == lo:
        return lo
    return sorted((r[0] for r in rows.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)[k - 1]


def select_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", max_labelled: int = MAX_LABELLED, seed: int = 17) -> DataFrame:
    """Per document: key, log_weight, n_grams, sample_key, kept.

    labels: (key, quality, toxic), nulls count as bad quality and not toxic; of repeated labels the worst counts. Null and
    empty texts have weight 0 (ratio 1). Without target labels every weight is 0 and every document is kept. Documents
    with equal sample keys at the cut are all kept; rows of a repeated key draw the same lot, and rows without a key draw
    one too. An empty table gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    arrow_bounds(spark)
    graded = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.coalesce(F.min(F.coalesce("quality", F.lit(0))), F.lit(0)) == 1).alias("fine"), (F.max(F.coalesce("toxic", F.lit(0))) == 1).alias("toxic"))
    graded = graded.select("key", (F.col("fine") & ~F.col("toxic")).alias("good"), (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(3)) == 0).alias("held_out"))
    graded = stored(graded.orderBy(F.xxhash64("key"), "key").limit(max_labelled))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    fitted = F.broadcast(graded.where("good and not held_out").select("key", F.lit(True).alias("is_target")))  # at most max_labelled keys
    counts = stored(bucket_counts(rows.join(fitted, "key", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))))
    scored = stored(log_weights(rows, log_ratios(counts)))
    held = scored.join(F.broadcast(graded.where("held_out")), "key").groupBy("key", "good").agg(F.min("log_weight").alias("log_weight")).toPandas()  # at most max_labelled keys
    cut = min(0.0, level(held["log_weight"].to_numpy(float), held["good"].to_numpy(bool)))
    draw = (F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    drawn = scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(draw)))
    k = drawn.where(F.col("log_weight") >= F.lit(cut)).count()
    least = kth_largest(drawn, "sample_key", k)
    return drawn.select(F.col("key").alias(key), "log_weight", "n_grams", "sample_key", (F.col("sample_key") >= F.lit(least)).alias("kept"))
