"""Phrase collocations from compressed position bitmaps, in the manner of SPAM.

Texts are cut into pieces that no phrase crosses. A task lays the words of a language out in a row of positions, with a free position
between pieces. A word's bitmap has a bit for each of its positions, in containers of SPAN positions; only containers with a bit
exist, which is the compression. Phrases are extended depth-first, some prefixes at a time: a prefix's containers are shifted by
one (the last bit goes on to the next container) and ANDed with those of the words that have the same container. What is left has
the ends of the longer phrase, and its population count says how often it occurs there.

Counts are added up in the task, and then over all tasks. There is a round for each length, and a phrase is extended only if all
its parts are frequent (others can't be part of a frequent phrase). Which ones those are is told by a table of FILTER_BITS
bits of hashes, the same size for every corpus: a collision costs a superfluous count, never a phrase.

Rows of more than SHARD positions are cut into shards that overlap by as much as a phrase may need; a phrase counts where it begins.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govlens.llm.common import arrow_bounds, by_bytes, stored, utf8

#: Positions of one container and of one shard. Prefix containers that are extended at once.
SPAN_BITS, SHARD, AT_ONCE = 4, 1 << 16, 1 << 13
SPAN = 1 << SPAN_BITS
#: Words that one task counts before it hands them on; phrases; words of a language that have a number, and positions that may add to them.
FLUSH, PHRASES, NUMBERED, AT_MOST = 300_000, 800_000, 150_000, 500_000
#: Text that is laid out at once, in bytes, and rows that are handed on at once.
LAID_BYTES, ROWS = 1 << 20, 100_000
#: Bits of a word's number in a phrase's code.
CODE_BITS = 21
FILTER_BITS = 1 << 26
#: Fixed value: makes the hash of two words differ from that of the same words the other way round.
_FACTOR = 10_368_889
#: Parts into which a language is split before its best phrases are ranked.
RANK_PARTS = 32

_lower = bytearray(bytes(range(256)).lower())
_ENDS = b".,;:!?\n\x0b\x0c\r"
_WORDS = bytes(_lower).translate(bytes.maketrans(_ENDS + b"\t", b" " * 11))
_PIECES = np.frombuffer(bytes(_lower).translate(bytes.maketrans(_ENDS + b"\t", b"\n" * 10 + b" ")), np.uint8)
_COUNTED = "lang string, phrase string, n long"


class Bitmaps:
    """The bitmaps of the words at some positions (0 is no word), as rows (word, container, bits) in order of containers."""

    def __init__(self, words: np.ndarray, positions: np.ndarray, end: int):
        known = np.flatnonzero(words)
        self.word, self.container, self.bits = _packed(words[known], positions[known])
        order = np.argsort(self.container, kind="stable")
        self.word, self.container, self.bits = self.word[order], self.container[order], self.bits[order]
        self.first = np.searchsorted(self.container, np.arange((end >> SPAN_BITS) + 3))

    def extended(self, code: np.ndarray, container: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All phrases that are a word longer: (code of the prefix, word, container, bits of the ends)."""
        over, inside = bits >> (SPAN - 1), (bits << 1) & (2**SPAN - 1)
        stay, go = np.flatnonzero(inside), np.flatnonzero(over)
        code, container = np.concatenate((code[stay], code[go])), np.concatenate((container[stay], container[go] + 1))
        bits = np.concatenate((inside[stay], over[go]))
        first, n = self.first[container], self.first[container + 1] - self.first[container]
        row = np.repeat(np.arange(len(code)), n)
        with_ = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        both = bits[row] & self.bits[with_]
        hit = np.flatnonzero(both)
        row = row[hit]
        return code[row], self.word[with_[hit]], container[row], both[hit]


def _packed(words: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, container, bits), in order of words, from pairs of words and positions in order of positions."""
    key = (words << 40) | positions
    key.sort()
    place = key >> SPAN_BITS
    opens = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(key) else np.zeros(0, np.int64)
    bits = np.bitwise_or.reduceat(np.int64(1) << (key & (SPAN - 1)), opens) if len(opens) else opens
    place = place[opens]
    return place >> (40 - SPAN_BITS), place & ((1 << (40 - SPAN_BITS)) - 1), bits


class Language:
    """The numbers and hashes of a language's frequent words, and how often its phrases were found so far."""

    def __init__(self, lang: str):
        self.lang, self.seed = lang, zlib.crc32(lang.encode() + b" ")
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.hashes = [0]
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def number(self, words: list[str], bits: np.ndarray) -> np.ndarray:
        """The numbers of words, 0 for those that are not frequent."""
        numbers, out = self.numbers, np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            found = numbers.get(word)
            if found is None:
                h = zlib.crc32(word.encode(), self.seed)
                if not bits[(h & (FILTER_BITS - 1)) >> 3] >> (h & 7) & 1:
                    continue
                found = numbers[word] = len(self.hashes)
                self.hashes.append(h)
            out[i] = found
        return out

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.size += len(codes)

    def merge(self) -> None:
        """Add up equal phrases."""
        if self.codes:
            codes = np.concatenate(self.codes)
            order = np.argsort(codes)
            codes, counts = codes[order], np.concatenate(self.counts)[order]
            opens = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
            self.codes, self.counts = [codes[opens]], [np.add.reduceat(counts, opens) if len(opens) else counts]
            self.size = len(opens)

    def rows(self, length: int) -> Iterator[pa.RecordBatch]:
        """What was found, as words, and forget it."""
        self.merge()
        spelled = pa.array([None, *self.numbers], pa.string())
        for codes, counts in zip(self.codes, self.counts):
            for at in range(0, len(codes), ROWS):
                some = codes[at : at + ROWS]
                words = [spelled.take(pa.array((some >> (CODE_BITS * k)) & (2**CODE_BITS - 1))) for k in range(length - 1, -1, -1)]
                columns = [pa.array([self.lang] * len(some), pa.string()), pc.binary_join_element_wise(*words, " "), pa.array(counts[at : at + ROWS])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])
        self.forget()


def find_phrases(words: np.ndarray, positions: np.ndarray, length: int, found: Language, pairs: np.ndarray | None, counted: int) -> None:
    """Add all phrases of so many words that begin at the first counted positions; a pair that pairs (a table of bits) doesn't have is not extended."""
    hashes = np.array(found.hashes, np.int64)
    for at in range(0, counted, SHARD):
        to = min(counted, at + SHARD)
        seen = slice(at, min(len(words), to + length - 1))
        base = positions[at]
        bitmaps = Bitmaps(words[seen], positions[seen] - base, int(positions[seen][-1] - base))
        begins = at + np.flatnonzero(words[at:to])
        prefix, container, bits = _packed(words[begins], positions[begins] - base)
        for some in range(0, len(prefix), AT_ONCE):
            part = slice(some, some + AT_ONCE)
            code, where, ends = prefix[part], container[part], bits[part]
            for _ in range(length - 1):
                row_code, word, where, ends = bitmaps.extended(code, where, ends)
                if pairs is not None:
                    before = row_code & (2**CODE_BITS - 1)
                    h = ((hashes[before] & 0xFFFFFF) * _FACTOR + hashes[word]) & (FILTER_BITS - 1)
                    kept = np.flatnonzero(pairs[h >> 3] >> (h & 7).astype(np.uint8) & 1)
                    row_code, word, where, ends = row_code[kept], word[kept], where[kept], ends[kept]
                code = (row_code << CODE_BITS) | word
            found.add(code, np.bitwise_count(ends).astype(np.int64))


def laid_out(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts in order, the text of each, and its position: one further than the last, two where a piece ended between."""
    raw, offsets = utf8(column)
    folded = _PIECES[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = (folded != 32) & (folded != 10)
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = inside[1:-1][edges]
    last[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(folded[inside[1:-1]])])
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(folded == 10)[starts] + text
    moved = np.concatenate(([0], piece[1:] != piece[:-1])) if len(starts) else np.zeros(0, np.int64)
    return words, text, np.arange(len(starts)) + np.cumsum(moved)


def _rows(counts: dict[bytes, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, c in counts.items() for _ in range(len(c))]
    columns = [pa.array(langs, pa.binary()).cast(pa.string()), pa.array([p for c in counts.values() for p in c], pa.binary()).cast(pa.string()), pa.array([n for c in counts.values() for n in c.values()], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, Counter] = {}
    for batch in by_bytes(batches, "text"):
        for lang, text in zip(pc.cast(batch.column("lang"), pa.binary()).to_pylist(), pc.cast(batch.column("text"), pa.large_binary()).to_pylist()):
            counts.setdefault(lang, Counter()).update(text.translate(_WORDS).split())
            if sum(map(len, counts.values())) > FLUSH:
                yield _rows(counts)
                counts = {}
    yield _rows(counts)


def _phrases(length: int, words, pairs):
    """Count phrases of so many words; words and pairs are broadcast tables of bits (pairs: None where length is 2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(words.value, np.uint8)
        extend = np.frombuffer(pairs.value, np.uint8) if pairs else None
        languages: dict[str, Language] = {}
        for batch in by_bytes(batches, "text", LAID_BYTES):
            found, text, positions = laid_out(batch.column("text"))
            named = batch.column("lang").dictionary_encode()
            of = named.indices.to_numpy()[text]
            for i, name in enumerate(named.dictionary.to_pylist()):
                own = np.flatnonzero(of == i)
                if not len(own):
                    continue
                language = languages.setdefault(name, Language(name))
                for at in range(0, len(own), AT_MOST):  # a text may be long
                    some = own[at : at + AT_MOST + length - 1]
                    distinct = found.take(pa.array(some)).dictionary_encode()
                    numbers = language.number(distinct.dictionary.to_pylist(), frequent)[distinct.indices.to_numpy()]
                    # texts of other languages leave gaps between positions, which end phrases just as well
                    find_phrases(numbers, positions[some], length, language, extend, min(AT_MOST, len(own) - at))
                    if language.size > 2 * PHRASES:
                        language.merge()
                    if language.size > PHRASES and len(language.codes) == 1 or len(language.hashes) > NUMBERED:
                        yield from language.rows(length)
                    if sum(x.size for x in languages.values()) > 4 * PHRASES:  # of many languages
                        for x in languages.values():
                            yield from x.rows(length)
        for x in languages.values():
            yield from x.rows(length)

    return count


def frequent_bits(phrases: DataFrame) -> bytes:
    """A table of FILTER_BITS bits with the hash of each (lang, phrase) of one or two words set."""
    h = lambda word: F.crc32(F.concat_ws(" ", "lang", word).cast("binary"))
    w = F.split("phrase", " ", -1)
    at = F.when(F.size(w) == 1, h(w[0])).otherwise((h(w[0]).bitwiseAND(F.lit(0xFFFFFF))) * _FACTOR + h(F.get(w, 1))).bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = phrases.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits"))
    found = parts.toArrow()
    table = np.zeros(FILTER_BITS // 32, "<u4")
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table.tobytes()


def _sum(counted: DataFrame, least: int = 1) -> DataFrame:
    """Add up what the tasks found. They have added up their own phrases already, so nothing more is merged before the shuffle."""
    return counted.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0]), wide[1] * wide[2])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 10, top: int = 2000) -> DataFrame:
    """The phrases of two and three words that occur together most: (lang, rank, phrase, a, l, r, n, score).

    n counts the words of a language, a the phrase's occurrences (at least min_count), l and r those of the two parts of the cut
    with the least score floor(1000000 * a * a / (l * r)), the earlier cut on ties. A phrase inside a longer one that occurs
    at least half as often is dropped. The first top phrases of each language by score, a and the phrase's bytes.

    A null text is empty, a null lang `und` (together with that name). Rows are documents, repeated or not. An empty table gives no
    rows. Further columns, the key among them, are not read.
    """
    spark = docs.sparkSession
    arrow_bounds(spark)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    every_word = stored(_sum(rows.mapInArrow(_words, _COUNTED)))
    words = every_word.where(F.col("n") >= min_count)
    word_bits = spark.sparkContext.broadcast(frequent_bits(words))
    pairs = stored(_sum(rows.mapInArrow(_phrases(2, word_bits, None), _COUNTED), min_count))
    pair_bits = spark.sparkContext.broadcast(frequent_bits(pairs))
    triples = stored(_sum(rows.mapInArrow(_phrases(3, word_bits, pair_bits), _COUNTED), min_count))

    w = F.split("phrase", " ", -1)
    two = triples.select("lang", "n", F.explode(F.array(F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2]))).alias("phrase"))
    longer = two.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = pairs.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 50 * n").drop("longer")

    def cut(k: int, left: Column, right: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))

    cuts = kept.withColumn("cut", F.array(cut(1, w[0], w[1]))).unionByName(triples.withColumn("cut", F.array(cut(1, w[0], F.concat_ws(" ", w[1], w[2])), cut(2, F.concat_ws(" ", w[0], w[1]), w[2]))))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), F.explode("cut").alias("cut")).select("lang", "phrase", "a", "cut.*")
    parts = stored(words.unionByName(pairs))
    found = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    found = found.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    scored = found.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = lowest.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = every_word.groupBy("lang").agg(F.sum("n").alias("n"))  # a row for each language
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
