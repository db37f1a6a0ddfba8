"""Hierarchical multi-length packing of documents into context windows.

Every Spark partition packs its own documents, in pools bounded by bytes, so nothing is shuffled:

1. routing: whole top-size windows are cut off long documents; what remains goes to the tier of the smallest window that
   holds it;
2. the top tier: each of its documents opens a long window, and its gap is filled from the shorter tiers, largest first;
   the last filler is cut where the window ends;
3. the shorter tiers: each window is filled to its end in the same way, so its length is exactly a power of two;
4. what is left stays in the pool for the next documents; at the partition's end it is cut into power-of-two windows.

Finished windows wait until they fill several step groups and are then dealt, longest first, to the emptiest group: groups
of one dealing differ by at most one window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes
from govlens.llm.tokens import encoded

END_ID = 2
#: Step groups that one dealing fills.
GROUPS = 8
#: Sequences of one partition have this many bits; the partition's number is above them.
LOCAL_BITS = 36


class _Pool:
    """Pieces (key, start, ids, tokens of the document) by tier, and the windows packed from them."""

    def __init__(self, top: int, floor: int, step_tokens: int):
        self.tiers = [1 << k for k in range(floor.bit_length() - 1, top.bit_length())]
        self.top, self.step_tokens = top, step_tokens
        self.waiting: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.windows: list[tuple[int, list[tuple]]] = []

    def tier_of(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def put(self, piece: tuple) -> None:
        self.waiting[self.tier_of(len(piece[2]) // 4)].append(piece)

    def add(self, key, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        while total - at >= self.top:
            self.windows.append((self.top, [(key, at, ids[4 * at : 4 * (at + self.top)], total)]))
            at += self.top
        if at < total:
            self.put((key, at, ids[4 * at :], total))

    def fill(self, size: int, pieces: list[tuple], below: list[int]) -> bool:
        """Fill a window of this size from these tiers, largest first; False if they ran out."""
        room = size - sum(len(p[2]) // 4 for p in pieces)
        for tier in reversed(below):
            queue = self.waiting[tier]
            while queue and room:
                if len(queue[-1][2]) // 4 > room and any(self.waiting[t] for t in below if t < tier):
                    break  # a shorter tier may fit whole
                key, start, ids, total = queue.pop()
                if len(ids) // 4 > room:
                    pieces.append((key, start, ids[: 4 * room], total))
                    self.put((key, start + room, ids[4 * room :], total))
                    room = 0
                else:
                    pieces.append((key, start, ids, total))
                    room -= len(ids) // 4
        for tier in below:
            queue = self.waiting[tier]
            while queue and room:
                key, start, ids, total = queue.pop()
                take = min(room, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    self.put((key, start + take, ids[4 * take :], total))
                room -= take
        if room:
            for piece in pieces:
                self.put(piece)
            return False
        self.windows.append((size, pieces))
        return True

    def tokens(self, tiers: list[int]) -> int:
        return sum(len(p[2]) // 4 for t in tiers for p in self.waiting[t])

    def pack(self) -> None:
        """Pack the top tier, then full windows of each shorter tier."""
        *shorter, top = self.tiers
        while self.waiting[top] and self.fill(top, [self.waiting[top].pop()], shorter):
            pass
        for k in range(len(shorter) - 1, -1, -1):
            size, from_tiers = shorter[k], shorter[: k + 1]
            while self.waiting[size] and self.fill(size, [self.waiting[size].pop()], from_tiers):
                pass

    def finish(self) -> None:
        """Cut all that waits into windows of the top size and then of ever smaller powers of two."""
        rest = [p for t in self.tiers for p in self.waiting[t]]
        self.waiting = {t: [] for t in self.tiers}
        left = sum(len(p[2]) // 4 for p in rest)
        size = self.top
        while left:
            if size > left:
                size >>= 1
                continue
            pieces, room = [], size
            while room:
                key, start, ids, total = rest.pop()
                take = min(room, len(ids) // 4)
                pieces.append((key, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    rest.append((key, start + take, ids[4 * take :], total))
                room -= take
            self.windows.append((size, pieces))
            left -= size

    def take(self, last: bool = False) -> list[tuple[int, int, list[tuple]]]:
        """Finished windows as (window, step group, pieces), longest first to the emptiest group.

        Windows wait until they fill GROUPS groups and one more, so that the partition's last groups are no remnants.
        """
        groups = GROUPS
        if last:
            groups = max(1, round(sum(w for w, _ in self.windows) / self.step_tokens))
        elif sum(w for w, _ in self.windows) < (GROUPS + 1) * self.step_tokens:
            return []
        done, tokens = [], 0
        while self.windows and (last or tokens < GROUPS * self.step_tokens):
            done.append(self.windows.pop())
            tokens += done[-1][0]
        heap = [(0, g) for g in range(groups)]
        out = []
        for size, pieces in sorted(done, key=lambda w: -w[0]):
            load, group = heap[0]
            heapq.heapreplace(heap, (load + size, group))
            out.append((size, group, pieces))
        return out


def pack_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", window: int = 4096, floor: int = 512, step_tokens: int = 1 << 18, with_ids: bool = False) -> DataFrame:
    """Cut and pack all documents: one row per piece.

    Columns: key, start (ids of its document before it), length, ids_crc32, doc_tokens (the closing id included),
    sequence_id, offset (in the sequence, without gaps), window (the sequence's length), step_group, and ids if asked for.
    A null or empty text is a document of the closing id alone. Rows of a repeated or null key are documents of their own.
    An empty table gives no rows. A key column with the name of another result column is refused; further columns are not
    read. window and floor are powers of two, the largest and the smallest tier.
    """
    if window & (window - 1) or floor & (floor - 1) or not 0 < floor <= window:
        raise ValueError("window and floor must be powers of two, floor not above window")
    closing = np.asarray([END_ID], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << LOCAL_BITS
        pool, made, step = _Pool(window, floor, step_tokens), 0, 0

        def emit(last: bool = False) -> pa.RecordBatch:
            nonlocal made, step
            rows: list[list] = [[] for _ in range(9 + with_ids)]
            groups = 0
            for size, group, pieces in pool.take(last):
                groups, at = max(groups, group + 1), 0
                for k, start, ids, total in pieces:
                    n = len(ids) // 4
                    for column, value in zip(rows, (k, start, n, zlib.crc32(ids), total, base + made, at, size, base + step + group)):
                        column.append(value)
                    if with_ids:
                        rows[9].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    at += n
                made += 1
            step += groups
            kinds = [key_type, *[pa.int64()] * 8, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

        key_type = pa.int64()
        for batch in by_bytes(batches, "text"):
            key_type = batch.schema.field("key").type
            for k, ids in zip(batch.column("key").to_pylist(), encoded(batch.column("text"), path)):
                pool.add(k, ids + closing)
            pool.pack()
            while (out := emit()).num_rows:
                yield out
        pool.finish()
        yield emit(last=True)

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"] + ["ids"] * with_ids
    if key in names[1:]:
        raise ValueError(f"the key column has the name of a result column: {key}")
    arrow_bounds(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"`{n}` long" for n in names[1:9]), *["ids array<int>"] * with_ids])
    return rows.mapInArrow(pack, schema).withColumnRenamed("key", key)
