"""Exact packing, source divergence and collocations against brute force, on rows with nulls, blanks, repeats, ties and clashing names."""

import functools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from govlens.llm.byte_tokens import ByteCodec
from govlens.llm.collocations import collocations, find_phrases, laid_out
from govlens.llm.divergence import batch_runs, run_lengths, share, source_divergence
from govlens.llm.exact_packing import Complements, best_fit, pack_exactly, plan, segments
from hypothesis import given, settings
from hypothesis import strategies as st

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = [f"w{i}" for i in range(40)]
_random = random.Random(5)
LONG = " ".join(_random.choice(WORDS) for _ in range(3079))  # one piece without marks
TEXTS = [
    None, "", "   \n\t ", "one", "one two", "One, two. ONE two; three", "a b c a b c. a b c", LONG, "é ü é ü é ü ü é", "x1y2 z3 İ ſ", "tab\tand\x0bmore\x0cends\rhere\x1cthere",
    "don't stop<|endoftext|>now ", " lead  two   three\n\n\nfour \n five\n six \n\n", "nbsp  x  y z 　 w", "a\nb\nc d\n", "é naïve ΣΑΣ 12 345 !!! --x", "y" * 5000, "word " * 3000,
]


def rows():
    out = [(i * 3, t, ("en", None, "de", "")[i % 4], ("a", None, "b")[i % 3], 1, "p") for i, t in enumerate(TEXTS)]
    rnd = random.Random(11)
    for i in range(120):
        text = ". ".join(" ".join(rnd.choice(WORDS[: 4 + i % 9]) for _ in range(rnd.randint(0, 12))) for _ in range(4))
        out.append((1000 + i // 2, text, ("en", "en", "de", None)[i % 4], ("a", "b", "c", "d", "")[i % 5], 2, "q"))
    return out + [(None, "w1 w2 w3", "en", "a", 3, "r"), (None, "w1 w2 w3", "en", "only", 3, "r")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n long, phrase string").repartition(5).cache()


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def whole_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(st.sampled_from("ab Z9.'\n\t\r\x1c\x85  é́ß中<|endoftext>")), max_size=4))
@settings(max_examples=150, deadline=None)
def test_byte_units_are_encoded_as_the_library_encodes_texts(texts):
    found = [np.frombuffer(x, "<u4").tolist() for x in ByteCodec.get(TOKENIZER).encode([t.encode() for t in texts])]
    assert found == [whole_ids(t) for t in texts]


def test_exact_packing_is_a_round_trip(docs):
    window = 64
    found = pack_exactly(docs, TOKENIZER, window=window, with_ids=True).collect()
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    expected = Counter()
    for key, text, *_ in rows():
        ids = whole_ids(text) + [0]
        start = piece = 0
        while start < len(ids):
            n = (len(ids) - start) % window or window
            expected[key, piece, start, tuple(ids[start : start + n])] += 1
            start, piece = start + n, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in found) == expected
    assert len(sequences) <= 1.05 * -(-sum(r.length for r in found) // window) + 1
    assert pack_exactly(docs.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        pack_exactly(docs.withColumnRenamed("doc_id", "piece"), TOKENIZER, key="piece")


@given(st.dictionaries(st.integers(1, 24), st.integers(1, 9), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plans_hold_every_piece_once_and_fill_exactly(numbers):
    window = 24
    counts = np.zeros(window + 1, np.int64)
    for n, c in numbers.items():
        counts[n] = c
    planned = plan(counts)
    used = Counter()
    for lengths, times in planned:
        assert sum(lengths) <= window and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(numbers)
    found = segments(planned, window)  # every number of every length has one place
    places = set()
    for n, c in numbers.items():
        own = np.flatnonzero(found["length"] == n)
        for number in range(c):
            at = own[np.searchsorted(found["number"][own], number, side="right") - 1]
            nth, place = divmod(number - found["number"][at], found["each"][at])
            places.add((n, found["sequence"][at] + nth, found["offset"][at] + place * n))
    assert len(places) == sum(numbers.values())
    plain = best_fit(counts, window)
    assert sum(t for _, t in plain) >= -(-sum(n * c for n, c in numbers.items()) // window)


@given(st.lists(st.integers(1, 12), min_size=1, max_size=14), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_complements_are_found_when_there_are_any(lengths, gap):
    import itertools

    counts = np.bincount(lengths, minlength=13)
    index = Complements(counts)
    first = lengths[0]
    index.take((first,), 1)  # the index is kept up to date
    left = list(lengths[1:])
    found = index.fill(gap, ())
    exists = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(left, k))
    assert (found is not None) == exists
    if found:
        assert sum(found) == gap and not Counter(found) - Counter(left)


def test_exact_complements_need_fewer_sequences_than_best_fit_alone():
    counts = np.zeros(101, np.int64)
    counts[[70, 50, 30, 25, 20, 10]] = [10, 20, 10, 20, 10, 10]  # 50+25+25, 70+30, ...
    assert sum(t for _, t in plan(counts)) <= sum(t for _, t in best_fit(counts, 100))
    assert {lengths for lengths, _ in plan(counts)} >= {(70, 30)}


def test_divergence_is_what_plain_counting_gives(docs):
    for least, top in ((2, 5), (30, 50), (10_000, 50)):
        found = {(r.lang, r.source, r.part, r["rank"]): (r.item, r.value) for r in source_divergence(docs, min_docs=least, top=top).collect()}
        counts, in_docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
        for _, text, lang, source, *_ in rows():
            lang, source = lang or "", source or ""
            groups[lang].add(source)
            words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            counts[lang, source].update(words)
            in_docs.update((lang, w) for w in set(words))
        expected = {}
        for lang, sources in groups.items():
            kept = [w for (x, w), n in in_docs.items() if x == lang and n >= least]

            def shares(c, kept=kept):
                n = sum(c[w] for w in kept)
                return {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

            p = {s: shares(counts[lang, s]) for s in sources}
            q = shares(sum((counts[lang, s] for s in sources), Counter()))
            for s in sources:
                pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
                best = [(q[w] - p[s][w], w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
                for part, items in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                    expected |= {(lang, s, part, i): (item.decode(), -value) for i, (value, item) in enumerate(items, 1)}
        assert found == expected
    assert source_divergence(docs.limit(0)).count() == 0


def test_runs_are_added_up_across_batches():
    text = pa.array(["aB a", "b", None, "c1a é"], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", "x", "y"]), pa.array(["s", "s", "t", "s"]), pa.array(["1", "2", "3", "4"]), text], ["lang", "source", "document", "text"])
    found = {(r["lang"], r["term"], r["source"]): (r["n_docs"], r["n"]) for r in batch_runs(batch).to_pylist()}
    assert found == {("x", "ab", "s"): (1, 1), ("x", "a", "s"): (1, 1), ("x", "b", "s"): (1, 1), ("y", "c", "s"): (1, 1), ("y", "a", "s"): (1, 1), ("y", "é", "s"): (1, 1)}
    table = pa.table({"lang": ["x"] * 7, "term": list("aaabbcc"), "source": list("sstttss"), "n_docs": range(7), "n": [1] * 7})
    for size in (1, 2, 3, 7):
        merged = [tuple(r.values()) for b in run_lengths(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert merged == [("x", "a", "s", 1, 2), ("x", "a", "t", 2, 1), ("x", "b", "t", 7, 2), ("x", "c", "s", 11, 2)]


@given(st.integers(0, 10**12), st.integers(0, 10**12), st.integers(1, 10**6))
def test_shares_are_exact(count, more, kept):
    assert share(np.array([count]), np.array([count + more]), kept)[0] == 1 + 10**9 * (count + 5) // (count + more + 5 * kept)


def test_collocations_are_what_plain_counting_gives(docs):
    for least, top in ((3, 2000), (10, 7)):
        found = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations(docs, min_count=least, top=top).collect()}
        counts = defaultdict(Counter)
        for _, text, lang, *_ in rows():
            for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                words = re.findall("[^ \t]+", piece)
                for k in (1, 2, 3):
                    counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        expected = {}
        for lang, c in counts.items():
            longer = Counter()
            for p, n in c.items():
                if len(p) == 3 and n >= least:
                    for inner in (p[:2], p[1:]):
                        longer[inner] = max(longer[inner], n)
            scored = []
            for p, a in c.items():
                if len(p) > 1 and a >= least and not (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                    score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                    scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
            n = sum(v for p, v in c.items() if len(p) == 1)
            expected |= {(lang, i): (p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)}
        assert found == expected
    assert collocations(docs.limit(0)).count() == 0


def test_bitmaps_find_phrases_across_containers_and_shards(monkeypatch):
    from govlens.llm import collocations as module

    rnd = random.Random(8)
    for shard, at_once, span in ((1 << 18, 1 << 15, 4), (7, 3, 2), (2, 1, 3), (1, 5, 1)):
        monkeypatch.setattr(module, "SHARD", shard)
        monkeypatch.setattr(module, "AT_ONCE", at_once)
        monkeypatch.setattr(module, "SPAN_BITS", span)
        monkeypatch.setattr(module, "SPAN", 1 << span)
        words = np.array([rnd.randrange(5) for _ in range(200)], np.int64)
        positions = np.cumsum([rnd.choice((1, 1, 1, 2)) for _ in words])
        place = dict(zip(positions.tolist(), words.tolist()))
        for length in (2, 3):
            language = module.Language("x")
            language.hashes = [0, 11, 22, 33, 44]
            find_phrases(words, positions, length, language, None, len(words))
            language.merge()
            expected = Counter()
            for p in place:
                run = [place.get(p + i, 0) for i in range(length)]
                if all(run):
                    expected[functools.reduce(lambda a, b: (a << module.CODE_BITS) | b, run)] += 1
            assert dict(zip(language.codes[0].tolist(), language.counts[0].tolist())) == expected


def test_words_are_laid_out_with_a_gap_between_pieces():
    words, text, positions = laid_out(pa.array(["A b. c", None, "d", "", "e\tf!!g \u00e9"]))
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f", "g", "\u00e9"] and text.tolist() == [0, 0, 0, 2, 4, 4, 4, 4] and positions.tolist() == [0, 1, 3, 5, 7, 8, 10, 11]
    assert [len(x) for x in laid_out(pa.array([], pa.string()))] == [0, 0, 0]
