"""Exact Jaccard join of documents as a metric-space join.

The distance of two shingle sets, 1 - |x & y| / |x | y|, is a metric, and linked documents are at most RADIUS apart.

1. Copies (equal sets) collapse to their smallest key.
2. Pivots: a link's two sets share one of their first n - ceil((1 - RADIUS) n) + 1 shingles in any common order, and one
   that is even earlier in the smaller set. Of all sets with such a shingle in common the smallest key is the pivot, and
   they form its region; a document near a boundary is replicated to the region of each of its shingles. The order puts
   shingles last that are frequent in a sample, which keeps regions small; it has no influence on the result. Regions that
   overlap are joined as one while they are small together.
3. A parity bitmap of about one bit a shingle bounds a distance from below (differing bits need differing shingles), and the
   number of differing bits is a metric too. Sampled members of a region are pivots: a link moves the distance to a pivot by
   no more than its own, so only members in such a window around each other are compared. Members of a region that no bitmap
   of it comes near are done, and the others meet again in the components of what is left.
4. There, with whole sets, sampled members are pivots of Voronoi cells: each member goes to the nearest one's cell and, since
   a link moves neither distance by more than RADIUS, also to every cell whose pivot is at most 2 RADIUS further away than
   the nearest. Cells recur until they are small or stop shrinking; then members are compared within RADIUS of each other's
   distance to the pivots. Members that a pivot has linked to each other need no comparison.
5. A large region is dealt to several tasks by pairs of chunks of its members.
6. Links leave a task as a forest, and the components of all forests are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes, mix, stored, utf8
from govlens.llm.components import Forest, connected_components
from govlens.llm.decontamination import _VALUE, grams, words

SHINGLE, PERCENT = 4, 85
#: Documents sampled for the order of shingles, and how many frequent shingles are put last.
ORDER_SAMPLE, ORDER_SIZE = 4_000, 200_000
#: Members of a region that one task compares; sets sent to every task instead of shuffling the texts.
CHUNK, MAX_SENT = 512, 1_000_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, in order."""
    word, first = words(raw, offsets, _IS_WORD, _VALUE)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = grams(word, shingle)
    inside = owner[: len(h)] == owner[shingle - 1 :] if len(h) else np.zeros(0, bool)
    owners, hashes = [owner[: len(h)][inside]], [h[inside]]
    for k in range(1, shingle):
        short = np.flatnonzero(counts == k)
        if len(short):
            owners.append(short)
            hashes.append(grams(word, k)[first[:-1][short]])
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], h[new]


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of shingles that several of the sampled documents hold, sorted by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            h, n = np.unique(shingle_sets(*utf8(batch.column("text")), shingle)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    every = max(1, rows.count() // ORDER_SAMPLE)
    sampled = rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(every)) == 0).select("text")
    found = sampled.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(ORDER_SIZE).toArrow()
    h, n = np.asarray(found["h"].combine_chunks()).view(np.uint64), np.asarray(found["n"].combine_chunks())
    order = np.argsort(h)
    return h[order], n[order]


def signatures(rows: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(key, n, h1, h2, k, bitmap, prefix) of each row (key, text): set size, hashes of the set, its first shingles.

    Of prefix the first k count when the partner's set is at least as large.
    """
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, shingle))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = frequent.value
        for batch in by_bytes(batches, "text"):
            size = batch.num_rows
            owner, h = shingle_sets(*utf8(batch.column("text")), shingle)
            n = np.bincount(owner, minlength=size)
            rank = np.zeros(len(h), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[at] == h, count[at], 0)
            order = np.argsort((owner << 32) + rank, kind="stable")
            place = np.arange(len(h)) - np.searchsorted(owner, owner)
            chosen = place < (n - (percent * n + 99) // 100 + 1)[owner]
            sums = []
            for salt in (1, 2):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)), dtype=np.uint64)))
                ends = np.searchsorted(owner, np.arange(size + 1))
                sums.append(pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n.astype(np.int64)), *sums, pa.array(n - (2 * percent * n + 99 + percent) // (100 + percent) + 1), _bitmaps(owner, h, n), _lists(owner[chosen], h[order][chosen], size)], ["key", "n", "h1", "h2", "k", "bitmap", "prefix"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(make, f"key {kind}, n long, h1 long, h2 long, k long, bitmap binary, prefix array<long>")


def _bitmaps(owner: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each text the parity of its shingles in 2**k >= n bits, at least 64, by hash."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(bits)))
    at = ends[owner] + (mix(h) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(packed)])


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            owner, h = shingle_sets(*utf8(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("key"), _lists(owner, h, batch.num_rows)], ["key", "shingles"])

    return rows.select("key", "text").mapInArrow(make, f"key {rows.schema['key'].dataType.simpleString()}, shingles array<long>")


class Region:
    """Shingle sets side by side, and their exact distances."""

    #: Members joined at once, pivots of a level, columns of one product, and how often cells may hold a member on average.
    LEAF, PIVOTS, COLUMNS, SPREAD = 24, 16, 2048, 3

    def __init__(self, values: np.ndarray, ends: np.ndarray, percent: int):
        self.size = np.diff(ends)
        self.percent, self.radius = percent, 1 - percent / 100
        _, self.column, seen = np.unique(values, return_inverse=True, return_counts=True)
        shared = seen > 1
        number = np.cumsum(shared) - 1
        keep = shared[self.column]
        owner = np.repeat(np.arange(len(self.size)), self.size)[keep]
        self.column = number[self.column[keep]]
        self.ends = np.searchsorted(owner, np.arange(len(self.size) + 1))
        self.n_columns = int(shared.sum())
        self.forest = Forest(len(self.size))
        self.cells = self.compared = 0  # for tests: cells made, and pairs compared within windows

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of sets a with sets b."""
        out = np.zeros((len(a), len(b)), np.float32)
        rows_a, rows_b = self._entries(a), self._entries(b)
        for at in range(0, self.n_columns, self.COLUMNS):
            out += self._dense(rows_a, at, len(a)) @ self._dense(rows_b, at, len(b)).T
        return out

    def _entries(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.ends[members + 1] - self.ends[members]
        first = np.repeat(self.ends[members] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        return np.repeat(np.arange(len(members)), n), self.column[first + np.arange(n.sum())]

    def _dense(self, entries: tuple[np.ndarray, np.ndarray], at: int, n: int) -> np.ndarray:
        row, column = entries
        here = (column >= at) & (column < at + self.COLUMNS)
        out = np.zeros((n, min(self.COLUMNS, self.n_columns - at)), np.float32)
        out[row[here], column[here] - at] = 1
        return out

    def link(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> None:
        common = common.astype(np.int64)
        union = self.size[a][:, None] + self.size[b][None, :] - common
        self.forest.link(a, b, 100 * common >= self.percent * union)

    def distances(self, members: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances of members from pivots; those within the radius are linked."""
        common = self.common(members, pivots)
        self.link(members, pivots, common)
        return 1 - common / (self.size[members][:, None] + self.size[pivots][None, :] - common)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link each of a with each of b that is within the radius."""
        if not len(a) or not len(b):
            return
        if len(a) * len(b) <= self.LEAF**2:
            self.link(a, b, self.common(a, b))
            return
        members = np.union1d(a, b)
        pivots = _spread(members, self.PIVOTS)
        distance = self.distances(members, pivots)
        self.cells += len(pivots)
        within = distance <= distance.min(axis=1, keepdims=True) + 2 * self.radius + 1e-6
        at_a, at_b = np.searchsorted(members, a), np.searchsorted(members, b)
        if within.sum() <= self.SPREAD * len(members) and within.sum(axis=0).max() <= 0.8 * len(members):
            for k in range(len(pivots)):
                self.join(a[within[at_a, k]], b[within[at_b, k]])
            return
        for left, right in _unlinked(self.forest.root, a, b):
            x, y = distance[np.searchsorted(members, left)], distance[np.searchsorted(members, right)]
            for rows, columns in _windows(x[:, 0], y[:, 0], np.full(len(x), self.radius + 1e-6), self.LEAF * 4):
                near = (np.abs(x[rows][:, None, :] - y[columns][None, :, :]) <= self.radius + 1e-6).all(axis=2)
                rows, columns = rows[near.any(axis=1)], columns[near.any(axis=0)]
                self.compared += len(rows) * len(columns)
                self.link(left[rows], right[columns], self.common(left[rows], right[columns]))


def _spread(members: np.ndarray, n: int) -> np.ndarray:
    return members[np.unique(np.linspace(0, len(members) - 1, n).astype(int))]


def _unlinked(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Two products of parts of a and b that hold every pair but those inside the largest component."""
    roots, counts = np.unique(root[np.concatenate((a, b))], return_counts=True)
    largest = roots[counts.argmax()]
    apart = root[a] != largest
    yield a[apart], b
    yield a[~apart], b[root[b] != largest]


def _windows(x: np.ndarray, y: np.ndarray, reach: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (rows, columns) that hold every pair with |x - y| <= the row's reach."""
    order, columns = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    for at in range(0, len(order), block):
        rows = order[at : at + block]
        lo, hi = np.searchsorted(y[columns], (x[rows] - reach[rows]).min()), np.searchsorted(y[columns], (x[rows] + reach[rows]).max(), side="right")
        if hi > lo:
            yield rows, columns[lo:hi]


class Bitmaps:
    """Parity bitmaps side by side, and which pairs they can't rule out."""

    LEAF, PIVOTS, BLOCK = 32, 4, 64

    def __init__(self, n: np.ndarray, bitmaps: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.width = np.array([len(b) // 8 for b in bitmaps])
        wide = int(self.width.max(initial=1))
        self.words = {}
        for w in (1 << k for k in range(int(self.width.min(initial=wide)).bit_length() - 1, wide.bit_length())):
            self.words[w] = np.zeros((len(n), w), np.uint64)
        for i, b in enumerate(bitmaps):
            self.words[len(b) // 8][i] = np.frombuffer(b, np.uint64)
        for w in sorted(self.words, reverse=True)[:-1]:  # halves folded together are the bitmap of half the bits
            own = self.width >= w
            self.words[w // 2][own] = self.words[w][own, : w // 2] ^ self.words[w][own, w // 2 :]
        self.forest = Forest(len(n))
        self.compared = 0  # for tests: pairs of bitmaps compared within windows

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link each of a with each of b that it may be linked with."""
        if len(a) * len(b) <= self.LEAF**2:
            self.link(a, b)
            return
        members = np.union1d(a, b)
        pivots = _spread(members, self.PIVOTS)
        self.link(pivots, members)
        least = self.words[min(self.words)]
        far = np.zeros((len(self.n), len(pivots)), np.int64)  # differing bits of each member and pivot
        for k, p in enumerate(pivots):
            far[members, k] = np.bitwise_count(least[members] ^ least[p]).sum(axis=1, dtype=np.int64)
        reach = (100 - self.percent) * self.n // self.percent  # differing shingles of a link, at most
        for left, right in _unlinked(self.forest.root, a, b):
            for rows, columns in _windows(far[left, 0], far[right, 0], reach[left], self.BLOCK):
                x, y = left[rows], right[columns]
                self.link(x, y, (np.abs(far[x][:, None, :] - far[y][None, :, :]) <= reach[x][:, None, None]).all(axis=2))

    def link(self, a: np.ndarray, b: np.ndarray, near: np.ndarray | bool = True) -> None:
        n_a, n_b = self.n[a][:, None], self.n[b][None, :]
        near = near & (100 * np.minimum(n_a, n_b) >= self.percent * np.maximum(n_a, n_b))
        near &= self.forest.root[a][:, None] != self.forest.root[b][None, :]
        x, y = np.nonzero(near)
        self.compared += len(x)
        width = np.minimum(self.width[a[x]], self.width[b[y]])
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            for at in range(0, len(own), 1 << 15):
                k = own[at : at + (1 << 15)]
                i, j = a[x[k]], b[y[k]]
                differ = np.bitwise_count(self.words[int(w)][i] ^ self.words[int(w)][j]).sum(axis=1, dtype=np.int64)
                near[x[k], y[k]] = (100 + self.percent) * differ <= (100 - self.percent) * (self.n[i] + self.n[j])
        self.forest.link(a, b, near)


def _candidates(regions: DataFrame, percent: int) -> DataFrame:
    """A forest (a, b) over the pairs of each group of rows (region, i, j, chunk, key, n, bitmap) that may be links."""

    def run(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        maps = Bitmaps(np.asarray(rows["n"]), rows["bitmap"].to_pylist(), percent)
        chunk = np.asarray(rows["chunk"])
        maps.join(np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))
        child, root = maps.forest.edges()
        return pa.table({"a": rows["key"].take(pa.array(child)), "b": rows["key"].take(pa.array(root))})

    kind = regions.schema["key"].dataType.simpleString()
    return regions.groupBy("region", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def _links(regions: DataFrame, percent: int) -> DataFrame:
    """A forest (a, b) over the links of each group of rows (region, i, j, chunk, key, shingles)."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = rows["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        ends = np.asarray(lists.offsets).astype(np.int64)
        region = Region(np.asarray(lists.values)[ends[0] : ends[-1]], ends - ends[0], percent)
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        chunk = np.asarray(rows["chunk"])
        region.join(np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))
        child, root = region.forest.edges()
        return pa.table({"a": rows["key"].take(pa.array(child)), "b": rows["key"].take(pa.array(root))})

    kind = regions.schema["key"].dataType.simpleString()
    return regions.groupBy("region", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def _members(base: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(region, key) of every distinct set that may have a link."""
    shingles = base.where("n > 0").select("key", "n", "k", F.posexplode("prefix").alias("pos", "shingle")).withColumn("small", F.when(F.col("pos") < F.col("k"), F.col("n")))
    blocks = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("region"), F.min("small").alias("small"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    blocks = blocks.where((F.col("m") > 1) & F.col("small").isNotNull() & ((F.col("m") > 2) | (100 * F.col("lo") >= percent * F.col("hi"))))
    blocks = stored(blocks.select("shingle", "region"))  # a table, so that the join of a hot shingle can be split
    met = shingles.select("shingle", "key").join(blocks, "shingle").select("region", "key").distinct()
    return met.join(sets.select(F.col("rep").alias("key")), "key", "left_semi")


def _sized(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return components.join(sizes, "component")


def _together(components: DataFrame, chunk: int) -> DataFrame:
    """(region, key): overlapping regions that are small together, as one."""
    return _sized(components).where(F.col("size") <= chunk).select(F.col("component").alias("region"), F.col("node").alias("key"))


def _apart(members: DataFrame, components: DataFrame, chunk: int) -> DataFrame:
    """(region, key) of the regions that aren't small together."""
    return members.join(_sized(components).where(F.col("size") > chunk).select(F.col("node").alias("key")), "key", "left_semi").select("region", "key")


def _dealt(members: DataFrame, chunk: int) -> DataFrame:
    """(region, i, j, chunk, key): which members meet in which task, by pairs of chunks of a region."""
    chunks = members.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("n_chunks"))
    parts = members.join(chunks, "region").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("n_chunks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return parts.select("region", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE, chunk: int = CHUNK, max_sent: int = MAX_SENT) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable by links, itself included).

    Null, empty and blank texts have an empty set and stand alone. Keys should be unique; a repeated key gives a row for
    each occurrence. A row without a key causes no link; it gets the component of its copies, or null. An empty table
    gives no rows. Other columns are not read.
    """
    arrow_bounds(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    base = stored(signatures(rows, percent, shingle))
    sets = stored(base.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("key").alias("rep")))
    members = stored(_members(base, sets, percent))
    met = connected_components(members.select(F.col("region").alias("a"), F.col("key").alias("b")))
    met = stored(_dealt(_together(met, chunk), chunk).unionByName(_dealt(_apart(members, met, chunk), chunk)))
    near = connected_components(_candidates(met.join(base.select("key", "n", "bitmap"), "key"), percent))
    dealt = stored(_dealt(near.select(F.col("component").alias("region"), F.col("node").alias("key")), chunk))
    few = dealt.limit(max_sent + 1).count() <= max_sent
    sent = F.broadcast if few else (lambda df: df)
    contents = _sets(rows.join(sent(dealt.select("key").distinct()), "key", "left_semi"), shingle)
    links = _links(contents.join(sent(dealt), "key"), percent)
    component = connected_components(links)
    of_set = sets.join(component, sets["rep"] == component["node"], "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    out = base.join(of_set, ["h1", "h2", "n"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
