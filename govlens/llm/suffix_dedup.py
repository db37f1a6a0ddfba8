"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash triggers phrases in every text (parsing.py). A phrase with the bytes that follow it is a dictionary entry;
the texts are sequences of entries, the parse.

1. Parse: one row per phrase, after equal entries of one batch have met (the later ones are repeats already).
2. Order of the parse: its phrases sorted by entry and place in the corpus. Every occurrence of an entry but the first is a
   repeat as a whole, and the first ones are the dictionary. No string of the length asked for reaches beyond its entry, so
   the parse needs no deeper order than this.
3. Order of the dictionary: only where one trigger key has several entries can part of an entry be a repeat. For buckets of
   whole keys a suffix array of those entries is built, word by word to the length asked for. Suffixes that agree that far
   lie side by side in it, in the order of the parse: both orders together are the corpus order, and in each run of equal
   suffixes all but the first are repeats. Keys with very many entries are grouped by Spark, suffix by suffix.
4. The bytes of all repeats are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes, mix, spans_hash, stored, utf8
from govlens.llm.parsing import _BYTE, phrases

LENGTH = 100
#: Bytes parsed at once, entries of a bucket, and entries of one key beyond which its suffixes are sorted by Spark.
PARSE_BYTES, BUCKET, HOT = 2 << 20, 15_000, 3_000
#: Text whose phrases meet in one partition, and the bits that hold a phrase's length.
PARTITION_BYTES, _N = 256 << 20, 0xFFFF
_48 = np.uint64((1 << 48) - 1)
_SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join spans of one document that overlap or touch; rows are sorted by document and start."""
    if not len(doc):
        return doc, start, end
    shift = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])).astype(np.int64)) << 40
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate(([True], (start + shift)[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(doc) - 1]))
    return doc[new], start[new], (reach - shift)[last]


def _parse(rows: DataFrame, length: int) -> DataFrame:
    """(h, c, c2, doc, lo, nt) of each phrase, n + 2**16 * (trigger's place in it); c null: a repeat [lo, nt) found on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PARSE_BYTES):
            raw, offsets = utf8(batch.column("text"))
            text, lo, n, trigger, key, content, check = phrases(raw, offsets, length)
            if not len(text):
                continue
            doc = np.asarray(batch.column("key"))[text]
            h, c, c2 = (key & _48).view(np.int64), content.view(np.int64), check.view(np.int64)
            order = np.lexsort((lo, doc, c2, c, h))
            same = np.concatenate(([False], np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (h, c, c2)])))
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            f, o = order[first], order
            again = np.zeros(len(h), bool)
            again[o[same & ((doc[o] != doc[f]) | (lo[o] != lo[f]))]] = True
            at = np.flatnonzero(again)
            at = at[np.lexsort((lo[at], doc[at]))]
            d, s, e = _merged(doc[at], lo[at], lo[at] + n[at] - 1 + length)
            at = np.flatnonzero(~again)
            none = np.concatenate((np.zeros(len(at), bool), np.ones(len(d), bool)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((h[at], mix(d.view(np.uint64)).view(np.int64) >> 16))), pa.array(np.concatenate((c[at], np.zeros(len(d), np.int64))), mask=none), pa.array(np.concatenate((c2[at], np.zeros(len(d), np.int64)))), pa.array(np.concatenate((doc[at], d))), pa.array(np.concatenate((lo[at], s))), pa.array(np.concatenate((n[at] + (trigger[at] << 16), e)))],
                ["h", "c", "c2", "doc", "lo", "nt"],
            )

    return rows.mapInArrow(run, "h long, c long, c2 long, doc long, lo long, nt long")


def _resolve(parsed: DataFrame, length: int) -> DataFrame:
    """From rows sorted by h, c, c2, doc, lo: repeats (doc, lo, nt = end, h null) and first occurrences of entries whose key has others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = last_c = last_c2 = None
        last_rep: tuple | None = None  # the entry's first occurrence
        pending = False  # that occurrence is the first of its key and not yet given out
        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc, lo, nt = (np.asarray(batch.column(c)) for c in ("h", "doc", "lo", "nt"))
            done = np.asarray(batch.column("c").is_null())
            found = [(doc[done], lo[done], nt[done])]
            if done.all():
                reps = np.zeros(0, np.int64)
                h, c, c2 = h[:0], h[:0], h[:0]
            else:
                c = np.asarray(batch.column("c").fill_null(0))[~done]
                c2 = np.asarray(batch.column("c2"))[~done]
                h, doc, lo, nt = h[~done], doc[~done], lo[~done], nt[~done]
                new_h = np.concatenate(([h[0] != last_h], h[1:] != h[:-1]))
                new_c = new_h | np.concatenate(([c[0] != last_c or c2[0] != last_c2], (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])))
                rep = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
                rep_doc, rep_lo = doc[rep], lo[rep]
                if rep[0] < 0:
                    carried = rep < 0
                    rep_doc[carried], rep_lo[carried] = last_rep[1], last_rep[2]
                again = ~new_c & ((doc != rep_doc) | (lo != rep_lo))
                found.append((doc[again], lo[again], lo[again] + (nt[again] & _N) - 1 + length))
                reps = np.flatnonzero(new_c)
            rows = [np.zeros(0, np.int64)] * 4
            if len(reps):
                opens = new_h[reps]
                several = ~opens | np.concatenate((~opens[1:], [False]))
                out = reps[several]
                rows = [h[out], doc[out], lo[out], nt[out]]
                if pending and not opens[0]:
                    rows = [np.concatenate(([v], r)) for v, r in zip(last_rep, rows)]
                pending = bool(opens[-1])
                last_rep = tuple(int(x[reps[-1]]) for x in (h, doc, lo, nt))
                last_h, last_c, last_c2 = h[-1], c[-1], c2[-1]
            spans = [np.concatenate(x) for x in zip(*found)]
            none = np.concatenate((np.zeros(len(rows[0]), bool), np.ones(len(spans[0]), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((rows[0], np.zeros(len(spans[0]), np.int64))), mask=none), *(pa.array(np.concatenate((r, s))) for r, s in zip(rows[1:], spans))], ["h", "doc", "lo", "nt"])

    return parsed.mapInArrow(run, "h long, doc long, lo long, nt long")


def _entries(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, hot, doc, lo, nt, bytes): the bytes of the wanted entries (h, hot, doc, lo, nt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", PARSE_BYTES):
            columns: list[list] = [[] for _ in range(6)]
            for doc, text, entries in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("entries").to_pylist()):
                for e in entries:
                    for column, value in zip(columns, (e["h"], e["hot"], doc, e["lo"], e["nt"], text[e["lo"] : e["lo"] + (e["nt"] & _N) - 1 + length])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["h", "hot", "doc", "lo", "nt", "bytes"])

    lists = wanted.groupBy(F.col("doc").alias("key")).agg(F.collect_list(F.struct("h", "hot", "lo", "nt")).alias("entries"))  # at most one a byte of the document
    return rows.join(lists, "key").select("key", "text", "entries").mapInArrow(run, "h long, hot boolean, doc long, lo long, nt long, bytes binary")


def suffix_array(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): suffixes from starts sorted by their first length bytes, ties in the order given; and whether each
    agrees that far with the one before it.

    Words of eight bytes are compared one after the other, each time only within runs of suffixes that agree so far.
    """
    words = np.zeros(len(raw) + length + 8, np.uint64)
    words[: len(raw)] = raw
    for width in (1, 2, 4):  # big-endian, so words sort as their bytes do
        words[:-width] = (words[:-width] << np.uint64(8 * width)) | words[width:]
    order = np.arange(len(starts))
    run = np.zeros(len(starts), np.int64)
    active = np.arange(len(starts))
    for at in range(0, length, 8):
        word = words[starts[order[active]] + at]
        if length - at < 8:
            word &= ~np.uint64((1 << (8 * (8 - length + at))) - 1)
        sort = np.lexsort((word, run[active]))
        order[active] = order[active[sort]]
        word, own = word[sort], run[active]
        opens = np.ones(len(active), bool)
        opens[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
        run[active] = active[np.maximum.accumulate(np.where(opens, np.arange(len(active)), 0))]
        alone = opens & np.concatenate((opens[1:], [True]))
        active = active[~alone]
        if not len(active):
            break
    same = np.zeros(len(order), bool)
    same[active] = True
    same[1:] &= run[1:] == run[:-1]
    same[:1] = False
    return order, same


def _suffixes(column: pa.Array, lo: np.ndarray, nt: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bytes of all entries, and (entry, place, bytes before the trigger, where it starts) of each suffix of each entry."""
    raw, offsets = utf8(column)
    n = nt & _N
    entry = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return raw, entry, lo[entry] + step, (nt >> 16)[entry] - step, offsets[:-1][entry] + step


def _bucket_repeats(entries: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """Repeats (doc, s, e) among the suffixes of all entries of a key, for buckets of whole keys."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("doc", "ascending"), ("lo", "ascending")])  # the order of the parse
        doc, lo, nt = (np.asarray(rows[c]) for c in ("doc", "lo", "nt"))
        column = rows["bytes"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        raw, entry, place, _, start = _suffixes(column, lo, nt)
        d = doc[entry]
        by_place = np.lexsort((place, d))
        order, same = suffix_array(raw, start[by_place], length)
        order = by_place[order]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        again = order[same & ((d[order] != d[order][first]) | (place[order] != place[order][first]))]
        again = again[np.lexsort((place[again], d[again]))]
        d, s, e = _merged(d[again], place[again], place[again] + length)
        return pa.table({"doc": d, "s": s, "e": e})

    keyed = entries.withColumn("bucket", F.pmod(F.col("h"), F.lit(n_buckets)))
    return keyed.groupBy("bucket").applyInArrow(run, "doc long, s long, e long")


def _hot_repeats(entries: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many entries, suffix by suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "bytes", PARSE_BYTES // 4):
            h, doc, lo, nt = (np.asarray(batch.column(c)) for c in ("h", "doc", "lo", "nt"))
            raw, entry, place, depth, start = _suffixes(batch.column("bytes"), lo, nt)
            code = spans_hash(_BYTE[raw], start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(mix(h[entry].view(np.uint64) ^ mix(depth.view(np.uint64))).view(np.int64)), pa.array(code.view(np.int64)), pa.array(doc[entry]), pa.array(place)], ["at", "code", "doc", "s"])

    suffixes = entries.mapInArrow(run, "at long, code long, doc long, s long")
    first = suffixes.groupBy("at", "code").agg(F.min(F.struct("doc", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "code", "first")
    return suffixes.join(first, ["at", "code"]).where(F.struct("doc", "s") > F.col("first")).select("doc", "s", (F.col("s") + length).alias("e"))


def _cut(rows: DataFrame, with_bytes: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            out: list[list] = [[] for _ in range(6)]
            for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist()):
                text = text or b""
                parts, at, removed, n = [], 0, 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if s > at or not n:
                        parts.append(text[at:s])
                        n += 1
                        removed -= s
                        at = s
                        removed += e
                        at = e
                    elif e > at:
                        removed += e - at
                        at = e
                parts.append(text[at:])
                kept = b"".join(parts)
                for column, value in zip(out, (key, len(text), removed, n, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(out, kinds))[: 5 + with_bytes]], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes])

    return rows.mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, bucket: int = BUCKET, hot: int = HOT, with_bytes: bool = False) -> DataFrame:
    """Remove each byte inside a string of length bytes that also starts earlier (smaller key, or earlier in the same text).

    Returns key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and the kept bytes if asked for. Null and
    empty texts have 0 bytes. Keys are integers and should be unique: rows of a repeated key lose what any of them loses to
    an earlier place. A row with a null key keeps its text and is no source. Other columns are not read.
    """
    spark = docs.sparkSession
    if length > _N:
        raise ValueError(f"length must be at most {_N}")
    arrow_bounds(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    keyed = rows.where("key IS NOT NULL")
    parsed = _parse(keyed.where(F.octet_length("text") >= length), length)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_BYTES)
    found = stored(_resolve(parsed.repartition(n, "h").sortWithinPartitions("h", "c", "c2", "doc", "lo"), length))
    partial = found.where("h IS NOT NULL")
    per_key = partial.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    n_entries = partial.count()
    wanted = partial.join(per_key.where(F.col("n") > hot).select("h", F.lit(True).alias("hot")), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    entries = stored(_entries(keyed, wanted, length))
    spans = found.where("h IS NULL").select("doc", F.col("lo").alias("s"), F.col("nt").alias("e"))
    spans = spans.unionByName(_bucket_repeats(entries.where("not hot"), max(1, -(-n_entries // bucket)), length)).unionByName(_hot_repeats(entries.where("hot"), length))
    lists = spans.groupBy(F.col("doc").alias("key")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # at most one a byte of the document
    return _cut(rows.join(lists, "key", "left").select("key", "text", "spans"), with_bytes).withColumnRenamed("key", key)
