"""Source divergence audit by sort-based streaming.

1. Every bounded batch of texts is sorted by (lang, term, source, document) where it is read, and a scan of its runs gives
   for each (lang, term, source) how many of the batch's documents have the term and how often: the pre-aggregation.
2. These partial runs are partitioned by ranges of (lang, term, source, document) and sorted within partitions. The document
   is part of the range, so a term that is in every document is split over many partitions. A streaming scan of run lengths
   adds the runs up; runs cut by a partition's end meet by (lang, term), with one row for each source and cut.
3. Terms in enough documents are kept and dealt into buckets of bounded size. Each bucket scans the runs of its terms and
   gives partial divergences for each pair of sources of the language and its best terms for each source; these are added
   up and ranked.

Shares are whole numbers of parts in SCALE, found by long division in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes, stored, utf8

SCALE = 1_000_000_000
#: Text that is sorted at once, in bytes.
SORT_BYTES = 8 << 20
#: Rows (one for each term and source) of one bucket, about; sources whose pairs one bucket holds; entries of its dense part.
BUCKET_ROWS, SOURCE_BLOCK, DENSE = 50_000, 1024, 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_RUN = "lang string, term string, source string, document string, n_docs long, n long"


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts in order, and the row of each."""
    raw, offsets = utf8(column)
    folded = _FOLD[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = folded != 32
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[1:-1][edges]  # no term goes on in the next text
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    data = folded[inside[1:-1]]
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return found, np.searchsorted(offsets, starts, side="right") - 1


def batch_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sort one batch by (term, lang, source, document) and scan its runs: a row of _RUN for each (lang, term, source)."""
    found, row = terms(batch.column("text"))
    vocabulary = found.dictionary_encode()
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    n_groups, n_rows = max(1, len(lang.dictionary) * len(source.dictionary)), batch.num_rows
    keys = (vocabulary.indices.to_numpy().astype(np.int64) * n_groups + group[row]) * n_rows + row
    keys.sort()
    runs = keys // n_rows
    opens = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1]))) if len(keys) else np.zeros(0, np.int64)
    new_document = np.concatenate(([True], keys[1:] != keys[:-1])).astype(np.int64) if len(keys) else keys
    n_docs = np.add.reduceat(new_document, opens) if len(opens) else opens
    term, group = np.divmod(runs[opens], n_groups)
    columns = [
        lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))), vocabulary.dictionary.take(pa.array(term)), source.dictionary.take(pa.array(group % max(1, len(source.dictionary)))),
        batch.column("document").take(pa.array(keys[opens] % n_rows)), pa.array(n_docs), pa.array(np.diff(np.append(opens, len(keys)))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "document", "n_docs", "n"])


def _local_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[pa.RecordBatch] = []
    size = 0

    def sorted_runs() -> pa.RecordBatch:
        return batch_runs(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    for batch in by_bytes(batches, "text", SORT_BYTES):
        waiting.append(batch)
        size += batch.nbytes
        if size >= SORT_BYTES:
            yield sorted_runs()
            waiting, size = [], 0
    if waiting:
        yield sorted_runs()


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up neighbouring rows of equal (lang, term, source), across batches too."""
    names = ["lang", "term", "source", "n_docs", "n"]
    open_run: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named = [batch.column(c) for c in names[:3]]
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in named])
        opens = np.flatnonzero(new)
        sums = [np.add.reduceat(batch.column(c).to_numpy(), opens) for c in names[3:]]
        at = pa.array(opens)
        named = [c.take(at) for c in named]
        key = tuple(c[0].as_py() for c in named)
        if open_run is not None and open_run[0] == key:
            for s, more in zip(sums, open_run[1]):
                s[0] += more
        elif open_run is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*open_run[0], *open_run[1])], names)
        open_run = (tuple(c[-1].as_py() for c in named), [int(s[-1]) for s in sums])
        yield pa.RecordBatch.from_arrays([*(c.slice(0, len(opens) - 1) for c in named), *(pa.array(s[:-1]) for s in sums)], names)
    if open_run is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*open_run[0], *open_run[1])], names)


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), three digits at a time: exact up to totals of 9e15."""
    rest = np.asarray(count, np.int64) + 5
    whole = np.asarray(total, np.int64) + 5 * kept
    out = np.zeros(np.broadcast(rest, whole).shape, np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _bucket_parts(top: int):
    names = ["lang", "source", "part", "item", "value"]

    def parts(key: tuple, runs: pa.Table, groups: pa.Table) -> pa.Table:
        """Of the runs of one bucket's terms: partial divergences of each pair of sources, and the best terms of each source."""
        lang, bucket, block = (k.as_py() for k in key)
        groups = groups.sort_by("source")
        sources, totals, kept = groups.column("source").combine_chunks(), groups.column("total").to_numpy(), groups.column("kept")[0].as_py()
        n, low = len(sources), block * SOURCE_BLOCK
        high = min(n, low + SOURCE_BLOCK)
        if low >= n or not (runs.num_rows or bucket == 0):
            return pa.Table.from_arrays([pa.array([], pa.string())] * 4 + [pa.array([], pa.int64())], names=names)
        vocabulary = runs.column("term").combine_chunks().dictionary_encode()
        spelled, code = vocabulary.dictionary, vocabulary.indices.to_numpy()
        source = pc.index_in(runs.column("source"), sources).to_numpy()
        count = runs.column("n").to_numpy()
        own = share(count, totals[source], kept) if len(count) else count
        distances = np.zeros((high - low, n), np.int64)
        absent = share(np.zeros(n, np.int64), totals, kept) if kept else np.zeros(n, np.int64)
        order = np.argsort(code, kind="stable")
        step = max(1, DENSE // n)
        for at in range(0, len(spelled), step):
            rows = order[np.searchsorted(code, at, sorter=order) : np.searchsorted(code, at + step, sorter=order)]
            dense = np.tile(absent, (min(step, len(spelled) - at), 1))
            dense[code[rows] - at, source[rows]] = own[rows]
            for g in range(low, high):
                distances[g - low] += np.abs(dense - dense[:, g : g + 1]).sum(axis=0)
        everywhere = np.zeros(len(spelled), np.int64)
        np.add.at(everywhere, code, count)
        above = own - share(everywhere, totals.sum(), kept)[code] if len(count) else count
        alphabet = np.empty(len(spelled), np.int64)
        alphabet[pc.sort_indices(spelled.cast(pa.binary())).to_numpy()] = np.arange(len(spelled))
        best = np.flatnonzero((above > 0) & (source >= low) & (source < high))
        best = best[np.lexsort((alphabet[code[best]], -above[best], source[best]))]
        first = np.searchsorted(source[best], source[best])
        best = best[np.arange(len(best)) - first < top]
        g, q = np.divmod(np.arange((high - low) * n), n)
        g, q, value = g[g + low != q], q[g + low != q], distances.ravel()[g + low != q]
        names_of = pa.concat_arrays([sources.take(pa.array(g + low)), sources.take(pa.array(source[best]))])
        items = pa.concat_arrays([sources.take(pa.array(q)), spelled.take(pa.array(code[best]))])
        part = pa.array(["pair"] * len(g) + ["term"] * len(best), pa.string())
        return pa.Table.from_arrays([pa.array([lang] * len(part), pa.string()), names_of, part, items, pa.array(np.concatenate((value, above[best])))], names=names)

    return parts


def source_divergence(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source", min_docs: int = 30, top: int = 50) -> DataFrame:
    """How far the sources of each language differ: (lang, source, part, item, value, rank).

    Each language keeps the terms (runs of letters of ASCII, in lower case, and of characters beyond it) in at least min_docs of
    its documents. Part `pair` ranks, for each (lang, source), all other sources of the language by the sum of the absolute
    differences of their shares over all kept terms (0 if none is kept); part `term` ranks the top terms that the source
    has and that have a larger share there than in the whole language. Ties are ranked by the item's bytes.

    Each row is a document, whether its key is repeated or null. A null text, lang or source is ''. An empty table gives no
    rows, a language of one source no pairs. Further columns are not read.
    """
    arrow_bounds(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    rows = docs.select(*named, F.col(key).cast("string").alias("document"), F.col(text).cast("string").alias("text"))
    local = stored(rows.mapInArrow(_local_runs, _RUN))
    at = ["lang", "term", "source", "document"]
    scanned = local.repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(run_lengths, "lang string, term string, source string, n_docs long, n long")
    counts = scanned.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    marked = counts.withColumns({"in_docs": F.sum("n_docs").over(term), "nth": F.row_number().over(term.orderBy("source"))})
    kept = stored(marked.where(F.col("in_docs") >= min_docs).select("lang", "term", "source", "n", (F.col("nth") == 1).alias("head")))

    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    n_kept = kept.where("head").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = docs.select(*named).distinct().join(total, ["lang", "source"], "left").join(n_kept, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")))
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    buckets, blocks = -(-kept.count() // BUCKET_ROWS) or 1, -(-widest // SOURCE_BLOCK)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    runs = kept.select("lang", "term", "source", "n", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), every)
    dealt = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")).select("*", every)
    by = ["lang", "bucket", "block"]
    found = stored(runs.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(_bucket_parts(top), "lang string, source string, part string, item string, value long"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(best)
