"""Benchmark decontamination by winnowing.

Of every sliding window of words the minimum k-gram hash is its fingerprint, for documents and items alike, so each shared
window has a shared fingerprint. Fingerprints are joined; a hit is extended to its whole window, which is then compared by a
hash of all its words, and neighbouring hits run together. Documents stay where they are while the items' fingerprints are
few (their bytes are checked); beyond that the two sides are joined by a shuffle: selected fingerprints first, and only windows
at those that both sides hold are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes, mix, powers, spans_hash, stored, utf8

WINDOW, GRAM = 10, 5
#: Up to so many bytes of item windows (two hashes and an item's number each) and of item names (with what Python adds to
#: each) are sent to every task; more are joined by a shuffle.
MAX_SENT, WINDOW_BYTES, NAME_BYTES = 48 << 20, 24, 72

_byte = np.arange(256)
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte)
_IS_WORD = (_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122))
_VALUE = mix(_LOWER.astype(np.uint64) + np.uint64(7919))


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = _IS_WORD, value: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, and where each text's words begin."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = is_word[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return spans_hash(value[raw], starts, ends), np.searchsorted(starts, offsets)


def grams(word_hash: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, across texts too."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = powers(k)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += word_hash[j : j + n] * power[j]
    return mix(total + np.uint64(k))


def window_minima(gram_hash: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of so many gram hashes."""
    n = len(gram_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = gram_hash[:n].copy()
    for j in range(1, size):
        np.minimum(out, gram_hash[j : j + n], out=out)
    return out


def _whole(first: np.ndarray, n_windows: int, length: int) -> np.ndarray:
    """Which windows of so many words lie in one text."""
    ok = np.ones(n_windows, bool)
    for j in range(1, length):
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < n_windows)]] = False
    return ok


def fingerprints(items: DataFrame, text: str, key: str) -> DataFrame:
    """Every window of every item: (item, length, fingerprint, window_hash). An item of too few words is one window."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            word_hash, first = words(*utf8(batch.column("text")))
            counts = np.diff(first)
            keys = batch.column("item")
            whole, print_, length, owner = [], [], [], []
            ok = np.flatnonzero(_whole(first, max(0, len(word_hash) - WINDOW + 1), WINDOW))
            whole.append(grams(word_hash, WINDOW)[ok])
            print_.append(window_minima(grams(word_hash, GRAM), WINDOW - GRAM + 1)[ok])
            owner.append(np.searchsorted(first, ok, side="right") - 1)
            length.append(np.full(len(ok), WINDOW))
            for k in range(1, WINDOW):
                short = np.flatnonzero(counts == k)
                if len(short):
                    h = grams(word_hash, k)[first[:-1][short]]
                    whole.append(h), print_.append(h), owner.append(short), length.append(np.full(len(short), k))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(length).astype(np.int32)), pa.array(np.concatenate(print_).view(np.int64)), pa.array(np.concatenate(whole).view(np.int64))], ["item", "length", "fingerprint", "window_hash"])

    rows = items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(make, f"item {kind}, length int, fingerprint long, window_hash long").distinct()


class _Index:
    """The items' windows of one length, sorted by hash, with a bitmap of their fingerprints."""

    BITS = 22

    def __init__(self, length: int, fingerprint: np.ndarray, window_hash: np.ndarray, items: np.ndarray):
        order = np.argsort(window_hash, kind="stable")
        self.length, self.hashes, self.items = length, window_hash[order], items[order]
        self.known = np.unique(fingerprint)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self.known & np.uint64((1 << self.BITS) - 1)] = True

    def candidates(self, values: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.bitmap[values & np.uint64((1 << self.BITS) - 1)])
        if not len(at):
            return at
        where = np.searchsorted(self.known, values[at])
        return at[self.known[np.minimum(where, len(self.known) - 1)] == values[at]]


def _hits(index: _Index, word_hash: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, from, to): a window of the texts and the slice of the index that holds its hash."""
    n = index.length
    if len(word_hash) < n:
        return
    values = window_minima(grams(word_hash, GRAM), WINDOW - GRAM + 1) if n == WINDOW else grams(word_hash, n)
    at = index.candidates(values)
    at = at[np.searchsorted(first, at, side="right") == np.searchsorted(first, at + n - 1, side="right")]
    if not len(at):
        return
    found = grams(word_hash[at[:, None] + np.arange(n)].ravel(), n)[::n] if n == WINDOW else values[at]
    lo, hi = np.searchsorted(index.hashes, found), np.searchsorted(index.hashes, found, side="right")
    for k in np.flatnonzero(hi > lo):
        yield int(at[k]), int(lo[k]), int(hi[k])


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", max_sent: int = MAX_SENT) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings).

    A word is hit inside any occurrence of WINDOW consecutive item words, or of all words of a shorter item. Null and empty
    texts have no words; items without words match nothing; repeated documents each get a row; an empty table on either
    side leaves every document clean. Other columns are not read, so their names are free.
    """
    arrow_bounds(docs.sparkSession)
    prints = stored(fingerprints(items, item_text, item_key))
    names = prints.select(F.col("item").cast("string").alias("item")).distinct().agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()
    few = WINDOW_BYTES * prints.count() + NAME_BYTES * names[0] + names[1] <= max_sent
    return _by_sent_index(docs, prints, text, key) if few else _by_shuffle(docs, prints, text, key)


def _by_sent_index(docs: DataFrame, prints: DataFrame, text: str, key: str) -> DataFrame:
    rows = prints.select(F.col("item").cast("string").alias("item"), "length", "fingerprint", "window_hash").toArrow()  # at most max_sent bytes
    lengths = np.asarray(rows["length"].combine_chunks())
    fingerprint, whole = (np.asarray(rows[c].combine_chunks()).view(np.uint64) for c in ("fingerprint", "window_hash"))
    coded = pc.dictionary_encode(rows["item"].combine_chunks().fill_null("None"))
    names, number = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    indexes = [_Index(int(n), fingerprint[at], whole[at], number[at]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]]
    sent = docs.sparkSession.sparkContext.broadcast((names, indexes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = _digest([])
        names, indexes = sent.value
        for batch in by_bytes(batches, "text"):
            word_hash, first = words(*utf8(batch.column("text")))
            cover = np.zeros(len(word_hash) + 1, np.int32)
            found: dict[int, set[int]] = {}
            for index in indexes:
                for start, lo, hi in _hits(index, word_hash, first):
                    cover[start] += 1
                    cover[start + index.length] -= 1
                    found.setdefault(int(np.searchsorted(first, start, side="right")) - 1, set()).update(index.items[lo:hi].tolist())
            hit = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
            n_hit = hit[first[1:]] - hit[first[:-1]]
            lists = [sorted(names[k] for k in found.get(i, ())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(first)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in lists], pa.int64()), pa.array([_digest(x) if x else nothing for x in lists]), pa.array(n_hit > 0), pa.array(lists, pa.list_(pa.string()))],
                ["key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>").withColumnRenamed("key", key)


def _by_shuffle(docs: DataFrame, prints: DataFrame, text: str, key: str) -> DataFrame:
    """The same with both sides' fingerprints joined by a shuffle, for a benchmark of any size."""
    lengths = [r[0] for r in prints.select("length").distinct().collect()]  # 1 to WINDOW

    def values(word_hash: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, fingerprint, hash) of each window of n words that lies in one text."""
        whole = grams(word_hash, n)
        print_ = window_minima(grams(word_hash, GRAM), WINDOW - GRAM + 1) if n == WINDOW else whole
        at = np.flatnonzero(_whole(first, len(whole), n))
        return at, print_[at], whole[at]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            word_hash, first = words(*utf8(batch.column("text")))
            for n in lengths:
                at, print_, _ = values(word_hash, first, n)
                owner = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((print_, owner))
                owner, print_ = owner[order], print_[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (print_[1:] != print_[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner[new])), pa.array(print_[new].view(np.int64))], ["row", "fingerprint"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            word_hash, first = words(*utf8(batch.column("text")))
            met = batch.column("met")
            ends = np.asarray(met.offsets).astype(np.int64)
            wanted = np.asarray(met.flatten()).view(np.uint64)
            holder = np.repeat(np.arange(len(met)), np.diff(ends))
            for n in lengths:
                at, print_, whole = values(word_hash, first, n)
                owner = np.searchsorted(first, at, side="right") - 1
                both = np.isin(mix(print_ + owner.astype(np.uint64)), mix(wanted + holder.astype(np.uint64)))
                at, print_, whole, owner = at[both], print_[both], whole[both], owner[both]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner)), pa.array(at - first[owner]), pa.array(np.full(len(at), n, np.int32)), pa.array(print_.view(np.int64)), pa.array(whole.view(np.int64))], ["row", "start", "length", "fingerprint", "window_hash"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            _, first = words(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(np.diff(first))], ["row", "key", "n_words"])

    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")))
    kind = rows.schema["key"].dataType.simpleString()
    selected = rows.select("row", "text").mapInArrow(select, "row long, fingerprint long")
    met = selected.join(stored(prints.select("fingerprint").distinct()), "fingerprint").groupBy("row").agg(F.collect_set("fingerprint").alias("met"))  # at most ten a word
    windows = rows.join(met, "row").select("row", "text", "met").mapInArrow(emit, "row long, start long, length int, fingerprint long, window_hash long")
    hits = windows.join(prints.withColumn("item", F.col("item").cast("string")), ["fingerprint", "window_hash", "length"])
    found = hits.groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("length") - 1))))).cast("long").alias("n_hit"),
    )
    counts = rows.mapInArrow(counted, f"row long, key {kind}, n_words long")
    out = counts.join(found, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return out.select(F.col("key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
