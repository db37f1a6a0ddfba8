"""Best-fit packing with exact complements, planned on numbers of pieces by length.

There are at most `window` lengths, so the whole plan is a function of one small histogram, whatever the corpus. Only that comes to
the driver. The longest length left opens sequences; an index of sums tells whether one, two or three of the other lengths fill
the gap exactly, and as many such sequences are planned at once as the numbers of pieces allow. What has no exact complement is
packed by best fit, again many equal sequences at once.

Pieces are numbered within their length without gathering a length anywhere: each task numbers its own, and sums over tasks say
where its numbers begin. A piece finds its sequence and place from its number by binary search in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.byte_tokens import encoded
from govlens.llm.common import arrow_bounds, by_bytes, stored


class Complements:
    """Which single, pair and triple sums the lengths that are left can make."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        self.window = len(counts) - 1
        here = (self.counts > 0).astype(np.float64)
        self.pairs = np.zeros(self.window + 1, np.int64)  # sums of two lengths that are left, ordered pairs
        both = np.rint(np.convolve(here, here))[: self.window + 1].astype(np.int64) if self.window <= 4096 else self._all_pairs()
        self.pairs[: len(both)] = both

    def _all_pairs(self) -> np.ndarray:
        out = np.zeros(self.window + 1, np.int64)
        lengths = np.flatnonzero(self.counts)
        for a in lengths:
            out[a + lengths[lengths <= self.window - a]] += 1
        return out

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.counts[n] -= times
        for n in set(lengths):
            if self.counts[n] == 0:  # leaves the index: its pairs with what is left, and with itself
                left = np.flatnonzero(self.counts)
                left = left[left <= self.window - n]
                self.pairs[n + left] -= 2
                if 2 * n <= self.window:
                    self.pairs[2 * n] -= 1

    def pair(self, gap: int, used: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """The two lengths with this sum, the longer one as long as can be; used are taken already."""
        if gap < 2 or self.pairs[gap] <= 0:
            return None
        free = self.counts
        if used:
            free = free.copy()
            for n in used:
                free[n] -= 1
        low = np.arange(1, gap // 2 + 1)
        fits = (free[low] > 0) & (free[gap - low] > 0) & ((2 * low != gap) | (free[low] > 1))
        at = np.flatnonzero(fits)
        return (int(gap - low[at[0]]), int(low[at[0]])) if len(at) else None

    def fill(self, gap: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap exactly."""
        if self.counts[gap] - used.count(gap) > 0:
            return (gap,)
        if found := self.pair(gap, used):
            return found
        firsts = np.flatnonzero(self.counts[:gap])[::-1]
        for a in firsts[self.pairs[gap - firsts] > 0]:
            a = int(a)
            if self.counts[a] > used.count(a) and (found := self.pair(gap - a, (*used, a))):
                return (a, *found)
        return None


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for counts[length] pieces of each length up to the window."""
    window = len(counts) - 1
    index = Complements(counts)
    out: list[tuple[tuple[int, ...], int]] = []
    if index.counts[window]:
        out.append(((window,), int(index.counts[window])))
        index.take((window,), int(index.counts[window]))
    for n in range(window - 1, 0, -1):
        while index.counts[n]:
            found = index.fill(window - n, (n,))
            if not found:
                break
            lengths = (n, *found)
            times = int(min(index.counts[x] // lengths.count(x) for x in lengths))
            out.append((lengths, times))
            index.take(lengths, times)
    return out + best_fit(index.counts, window)


def best_fit(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: each piece goes to the fullest sequence that has room; equal sequences are kept as one entry."""
    bins: dict[int, list[list]] = {}  # room: [lengths, number of sequences]
    for n in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[n])
        for room in sorted(r for r in bins if r >= n):
            each = room // n  # the fullest sequence stays the fullest until it is full
            kept = []
            for lengths, number in bins.pop(room):
                full = min(number, left // each)
                left -= full * each
                part = min(left, each - 1) if full < number else 0
                left -= part
                for times, put in ((full, each), (1 if part else 0, part)):
                    if times:
                        bins.setdefault(room - put * n, []).append([lengths + (n,) * put, times])
                if number - full - (part > 0):
                    kept.append([lengths, number - full - (part > 0)])
            if kept:
                bins.setdefault(room, []).extend(kept)
            if not left:
                break
        each = window // n
        for times, put in ((left // each, each), (1 if left % each else 0, left % each)):
            if times:
                bins.setdefault(window - put * n, []).append([(n,) * put, times])
    return [(lengths, times) for same in bins.values() for lengths, times in same]


def segments(planned: list[tuple[tuple[int, ...], int]], window: int) -> dict[str, np.ndarray]:
    """The plan by length and number: from this number of this length on, each sequence takes so many pieces from this offset on."""
    rows, taken, sequence = [], np.zeros(window + 1, np.int64), 0
    for lengths, times in planned:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            each = lengths.count(n)
            rows.append((n, int(taken[n]), sequence, each, offset))
            taken[n] += times * each
            offset += n * each
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "number", "sequence", "each", "offset"))}


def _places(found: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of pieces, given as numbers within their length."""
    at = np.empty(len(length), np.int64)
    for n in np.unique(length):
        low, high = np.searchsorted(found["length"], [n, n + 1])
        own = length == n
        at[own] = low + np.searchsorted(found["number"][low:high], number[own], side="right") - 1
    nth, place = np.divmod(number - found["number"][at], found["each"][at])
    return found["sequence"][at] + nth, found["offset"][at] + place * length


def pack_exactly(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", window: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most window tokens: one row per piece.

    Columns: key, piece (from 0), start (ids of its document before it), length, ids_crc32, sequence_id, offset, and ids if asked for.
    Documents of more than window tokens (the closing id included) are cut into pieces of window tokens, the first of which may be
    shorter. A null or empty text is the closing id alone. Rows of a repeated or null key are documents of their own. An
    empty table gives no rows. A key column with the name of another result column is refused; further columns are not read.
    """
    names = ["key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "task", "number"]
    if key in (*names[1:], "sequence_id", "offset"):
        raise ValueError(f"the key column has the name of a result column: {key}")
    if window < 1:
        raise ValueError("window must be positive")
    spark = docs.sparkSession
    arrow_bounds(spark)
    closing = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in by_bytes(batches, "text"):
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for k, ids in zip(batch.column("key").to_pylist(), encoded(batch.column("text"), path)):
                ids += closing
                total, start, piece = len(ids) // 4, 0, 0
                while start < total:
                    n = (total - start) % window or window
                    part = ids[4 * start : 4 * (start + n)]
                    for column, value in zip(rows, (k, piece, start, n, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] * with_ids))):
                        column.append(value)
                    start, piece = start + n, piece + 1
            number = []
            for n in rows[3]:
                number.append(seen[n])
                seen[n] += 1
            kinds = [batch.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            columns = [pa.array(c, t) for c, t in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(number), pa.int32()), pa.array(number, pa.int64())], names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    own = f"key {kind}, piece int, start long, length long, ids_crc32 long, {'ids array<int>, ' * with_ids}"
    pieces = stored(rows.mapInArrow(cut, own + "task int, number long"))

    by_task = stored(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("pieces")))
    counts = np.zeros(window + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("pieces").alias("pieces")).toLocalIterator():  # at most window rows
        counts[row["length"]] = row["pieces"]
    found = spark.sparkContext.broadcast(segments(plan(counts), window))
    before = F.sum("pieces").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begins = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("begins"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number, begins = (batch.column(c).to_numpy() for c in ("length", "number", "begins"))
            sequence, offset = _places(found.value, length, number + begins)
            columns = [batch.column(c) for c in names[: 5 + with_ids]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names[: 5 + with_ids], "sequence_id", "offset"])

    placed = pieces.join(begins, ["length", "task"]).mapInArrow(place, own + "sequence_id long, offset long")
    return placed.withColumnRenamed("key", key)
