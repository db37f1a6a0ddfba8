"""Operators on texts against brute force, on rows with nulls, blanks, repeats, ties and clashing column names."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from govlens.llm.common import mix
from govlens.llm.decontamination import contamination
from govlens.llm.jaccard import Bitmaps, Region, _bitmaps, jaccard_components
from govlens.llm.line_dedup import MIN_LINES, MIN_WORDS, dedup_lines, line_windows, matched_windows, repeated_runs
from govlens.llm.packing import GROUPS, pack_documents
from govlens.llm.sharding import longest_first, shard_documents
from govlens.llm.suffix_dedup import remove_repeats, suffix_array
from govlens.llm.tokens import LONG_WORD, WordCodec, encoded, token_counts
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BASE = " ".join(f"word{i % 37}x{i % 11} Tail{i}" for i in range(120))
NEAR = BASE.replace("Tail60", "changed")
LINES = "\n".join(f"line number {i} of a list that repeats" for i in range(6))
TEXTS = [
    None, "", "   \n\t ", "one", "one two three", "ONE two THREE", BASE, BASE, NEAR, BASE + " and more", LINES, "head\n" + LINES + "\ntail", LINES + "\n" + LINES,
    "a" * 400, "ab" * 300, "é" * 90, "x" * 99, "y" * 100, "y" * 100, "naïve ΣΑΣ <|endoftext|> 's don't 12 345 end x", "long " * 20_000, "\n\n\n", BASE.upper(),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "key", "n", 1.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n string, h1 double").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def whole_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_token_counts_are_the_library_s(docs, none):
    found = by_id(token_counts(docs, TOKENIZER, limit=100))
    for i, t in enumerate(TEXTS):
        r, n = found[i * 3], len(whole_ids(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 100), i
    assert token_counts(none, TOKENIZER).count() == 0


def test_packing_is_a_round_trip(docs, none):
    rows = pack_documents(docs, TOKENIZER, window=256, floor=16, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in r.ids)) == r.ids_crc32
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        own = sorted(pieces[i * 3], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == whole_ids(t) + [2], i
        at = 0
        for r in own:
            assert r.start == at and r.length == len(r.ids) > 0 and r.doc_tokens == len(whole_ids(t)) + 1
            at += r.length
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].window <= 256 and at & (at - 1) == 0
    assert pack_documents(none, TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, TOKENIZER, window=100)
    with pytest.raises(ValueError):
        pack_documents(docs.withColumnRenamed("doc_id", "length"), TOKENIZER, key="length")


def test_step_groups_are_even(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(i, " ".join(words[(i * j) % 10] for j in range(1 + i * 37 % 300))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    windows = pack_documents(df, TOKENIZER, window=256, floor=16, step_tokens=4096).select("sequence_id", "window", "step_group").distinct().collect()
    tokens = defaultdict(int)
    for r in windows:
        tokens[r.step_group] += r.window
    sizes = [tokens[g] for g in sorted(tokens)]
    assert len(sizes) > 3 * GROUPS
    full, rest = sizes[: len(sizes) // GROUPS * GROUPS - GROUPS], sizes[len(sizes) // GROUPS * GROUPS - GROUPS :]
    assert all(4096 - 256 <= n <= 4096 + 256 for n in full) and all(4096 // 2 <= n <= 4096 * 3 // 2 for n in rest)
    for at in range(0, len(full), GROUPS):
        assert max(full[at : at + GROUPS]) - min(full[at : at + GROUPS]) <= 256


def test_codec_agrees_with_the_library_on_odd_words(spark):
    texts = [
        "ΣΑΣ Σa.Σ aΣ. J̌ ǰ É x≠ a≮ word≠", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|> endoftext|> DON'T don't. it's, we'll! 'sa 's. 's' re're",
        "İstanbul ǅ ﬁ ß ÀÉ é. naïve, straße! 12a a12 a_b A_ ___ x", "ñ ÿ ª º µ ×÷ a× ÷b", " a b c. d\u0085e", "KK Å Å. Ω", "x" * 300 + " " + "ab." * 100, "a\x0bb\x0cc\x1cd\x1de",
    ]
    texts.append(" ".join(texts))
    for batch in (texts, texts[::-1]):
        found = list(encoded(pa.array([*batch, None]), TOKENIZER))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [*map(whole_ids, batch), []]
    assert max(map(len, WordCodec.get(TOKENIZER).known)) <= LONG_WORD


def brute_shards(texts, shards):
    """Longest first over groups of equal texts: each goes to the shard with the fewest bytes."""
    groups = defaultdict(int)
    for t in texts:
        groups[t] += len((t or "").encode()) + 8
    load = [0] * shards
    for size in sorted(groups.values(), reverse=True):
        load[load.index(min(load))] += size
    return sorted(load)


@pytest.mark.parametrize("shards", [2, 5])
def test_shards_against_longest_first_over_all_groups(spark, shards):
    """Where every group is an item of its own, the loads are those of the plain method; elsewhere no worse by a bundle."""
    dice = random.Random(6)
    few = [chr(97 + i) * dice.randrange(200, 900) for i in range(20)]
    texts = [dice.choice(few) for _ in range(60)] + [None]
    loads = lambda rows: sorted(r.n for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect())
    found = loads(shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=shards))
    expected = brute_shards(texts, shards)
    assert found == expected
    many = [f"{i} " * dice.randrange(1, 60) for i in range(4000)]
    found, expected = loads(shard_documents(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string"), shards=shards)), brute_shards(many, shards)
    assert sum(found) == sum(expected) and max(found) - max(expected) <= 0.002 * max(expected)


def test_shards_keep_copies_together_and_are_even(docs, none, spark):
    rows = shard_documents(docs, shards=3).collect()
    assert {r.doc_id for r in rows} == {i * 3 for i in range(len(TEXTS))}
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        t = TEXTS[r.doc_id // 3]
        assert r["size"] == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        slots[r.shard].append(r.slot)
        of_text[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 97).cast("int")).alias("text")).withColumn("text", F.concat("text", F.col("doc_id").cast("string")))
    sizes = [r[0] for r in shard_documents(many, shards=8).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * max(sizes)
    assert shard_documents(none).count() == 0
    assert longest_first([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def brute_lines(texts):
    """The text without the lines of any run that occurred before, by plain comparison of every window with all earlier ones."""
    seen, out = set(), {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        worded = [k for k, x in enumerate(lines) if any(x.split(" "))]
        gone = set()
        for a in range(len(worded)):
            for n in range(1, MIN_LINES + 1):
                own = worded[a : a + n]
                run = tuple(lines[k] for k in own)
                if len(own) < n or n < MIN_LINES and sum(len([w for w in x.split(" ") if w]) for x in run) < MIN_WORDS:
                    continue
                if run in seen:
                    gone |= set(range(own[0], own[-1] + 1))
                seen.add(run)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
    return out


def test_line_dedup_deletes_later_runs(docs, none):
    found = by_id(dedup_lines(docs))
    expected = brute_lines(TEXTS)
    assert {i: found[i * 3].text for i in expected} == expected
    assert found[10 * 3].n_deleted == 0 and found[11 * 3].text == "head\ntail" and found[0].n_lines == 0 and found[3].n_lines == 1
    assert found[0].asDict().keys() >= {"key", "n", "h1"}
    assert dedup_lines(none).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(docs.withColumn("n_lines", F.lit(1)))
    clash = docs.withColumn("n_lines", F.lit(1)).withColumn("deleted_runs", F.lit("x"))
    assert by_id(dedup_lines(clash, added=("a", "b")))[11 * 3].asDict().items() >= {"text": "head\ntail", "n_lines": 1, "deleted_runs": "x", "b": 6}.items()


def test_matches_are_joined_with_first_places_and_extended(spark):
    run = [f"line {c} of it" for c in "abcdefg"]
    texts = ["\n".join(["x", *run, "y"]), "\n".join(["p", "q", *run[:5], "z", *run[3:]]), "\n".join(run[2:6])]
    windows = line_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    matches = matched_windows(windows)
    assert {(r.key, r.pos, r.last, r.source, r.source_pos) for r in matches.where("key = 2").collect()} == {(2, 0, 2, 0, 3), (2, 1, 3, 0, 4)}
    found = {(r.key, r.source, r.distance, r.pos, r.last) for r in repeated_runs(matches).collect()}
    assert found == {(1, 0, 1, 2, 6), (1, 0, 4, 8, 11), (2, 0, -3, 0, 3)}  # whole runs, each one longer than a window


def test_line_dedup_extends_runs_to_their_last_line(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = ["\n".join((long, "a b", "c d", "own")), "\n".join(("head", long, "a b", "c d", "other")), "\n".join((long, "", "a b")), f"x\n{long}\na b\nelse"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == {0: texts[0], 1: "head\nother", 2: "", 3: "x\nelse"}


def brute_runs(texts):
    """All runs of every length that occurred before, not only the shortest at each line."""
    lines = [(t or "").split("\n") for t in texts]
    seen, out = set(), []
    for own in lines:
        worded = [k for k, x in enumerate(own) if any(x.split(" "))]
        gone = set()
        for a in range(len(worded)):
            for b in range(a + 1, len(worded) + 1):
                run = tuple(own[k] for k in worded[a:b])
                if len(run) < MIN_LINES and sum(len([w for w in x.split(" ") if w]) for x in run) < MIN_WORDS:
                    continue
                if run in seen:
                    gone |= set(range(worded[a], worded[b - 1] + 1))
                seen.add(run)
        out.append("\n".join(x for k, x in enumerate(own) if k not in gone))
    return out


def test_line_dedup_against_all_runs(spark):
    dice = random.Random(5)
    words = [" ".join(f"v{i}" for i in range(n)) for n in (1, 2, 3, 24, 26, 49, 50, 60)] + [""]
    texts = ["\n".join(dice.choices(words, k=dice.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r.text for r in dedup_lines(df).orderBy("doc_id").collect()] == brute_runs(texts)


def test_line_dedup_plan_is_native(docs):
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def ascii_lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("percent,shingle,chunk,max_sent", [(85, 4, 1024, 1000), (80, 5, 2, 0), (50, 1, 3, 1000)])
def test_jaccard_components_are_exact(docs, none, percent, shingle, chunk, max_sent):
    found = by_id(jaccard_components(docs, percent=percent, shingle=shingle, chunk=chunk, max_sent=max_sent))
    sets = [shingles(t, shingle) for t in TEXTS]
    root = components(len(TEXTS), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    assert [(found[i * 3].n_shingles, found[i * 3].component_id) for i in range(len(TEXTS))] == [(len(s), 3 * r) for s, r in zip(sets, root)]
    assert jaccard_components(none).count() == 0


def test_jaccard_large_region_recurs(spark):
    rows = [(i, " ".join(f"t{k if (k * 7 + i) % 23 else i * 1000 + k}" for k in range(60))) for i in range(260)] + [(1000 + i, " ".join(f"u{k if (k * 5 + i) % 61 else i * 1000 + k}" for k in range(120))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = by_id(jaccard_components(df, percent=85, shingle=1, chunk=50))
    sets = [shingles(t, 1) for _, t in rows]
    root = components(len(rows), lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    assert [found[k].component_id for k, _ in rows] == [rows[r][0] for r in root]
    assert by_id(jaccard_components(df, percent=85, shingle=1)) == found


@pytest.mark.parametrize("percent", [85, 50])
@pytest.mark.parametrize("parts", [1, 3])
def test_pivots_decide_within_a_region(percent, parts):
    """Exact sets and bitmaps of one large region: pivots and windows leave few pairs to compare and lose none."""
    dice = np.random.default_rng(4)
    chain = [np.arange(3 * i, 3 * i + 60) for i in range(200)]
    groups = [np.unique(np.where(dice.random(120) < 0.1, dice.integers(10**6, 10**9, 120), np.arange(120) * 7 + c * 10**4)) for c in range(4) for _ in range(60)]
    sets = [x.astype(np.uint64) for x in dice.permuted(np.array([*chain, *groups], object))]
    n = np.array([len(x) for x in sets])
    plain = [set(x.tolist()) for x in sets]
    root = components(len(sets), lambda i, j: 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j]))
    values, ends = np.concatenate(sets), np.concatenate(([0], np.cumsum(n)))
    region = Region(values, ends, percent)
    maps = Bitmaps(n, _bitmaps(np.repeat(np.arange(len(n)), n), mix(values), n).to_pylist(), percent)
    for i in range(parts):
        for j in range(i, parts):
            a, b = np.arange(len(sets))[i::parts], np.arange(len(sets))[j::parts]
            region.join(a, b)
            maps.join(a, b)
    assert region.forest.root.tolist() == root
    assert all(len({maps.forest.root[i] for i in range(len(sets)) if root[i] == r}) == 1 for r in set(root))
    assert region.cells > 0 and region.compared < len(sets) ** 2 and maps.compared < len(sets) ** 2 // 2


def brute_bytes(texts, length):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return out


@pytest.mark.parametrize("length", [1, 7, 8, 20, 33])
def test_suffix_array_against_sorting(length):
    dice = random.Random(length)
    raw = bytes(dice.choice(b"ab\xc3\xff\x00") for _ in range(3000)) + b"ab" * 200
    starts = dice.sample(range(len(raw) - length), 2500)
    order, same = suffix_array(np.frombuffer(raw, np.uint8), np.array(starts), length)
    expected = sorted(range(len(starts)), key=lambda k: raw[starts[k] : starts[k] + length])
    assert order.tolist() == expected
    cut = [raw[starts[k] : starts[k] + length] for k in expected]
    assert same.tolist() == [k > 0 and cut[k] == cut[k - 1] for k in range(len(cut))]
    assert suffix_array(np.zeros(0, np.uint8), np.zeros(0, np.int64), length)[0].tolist() == []


@pytest.mark.parametrize("length,bucket,hot", [(100, 15_000, 3_000), (40, 3, 1), (400, 15_000, 3_000), (400, 3, 1)])
def test_suffix_dedup_is_exact(docs, none, length, bucket, hot):
    short = docs.withColumn("text", F.substring("text", 1, 3000))
    found = by_id(remove_repeats(short, length=length, bucket=bucket, hot=hot, with_bytes=True))
    for i, expected in brute_bytes([t and t[:3000] for t in TEXTS], length).items():
        r = found[i * 3]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == expected, i
    assert remove_repeats(none).count() == 0


def test_suffix_dedup_keys(spark):
    rows = [(1, "q" * 150 + "r" * 20), (1, "q" * 150 + "r" * 20), (None, "s" * 300), (5, "s" * 300)]
    found = [(r.doc_id, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted([(1, 149), (1, 149), (None, 0), (5, 299)], key=str) or len(found) == 4


def brute_hits(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[p : p + 10])].add(str(k))
    out = []
    for t in texts:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    names |= windows[tuple(w[p : p + n])]
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, " ".join(BASE.split()[20:45])), (2, "of A list"), (10, "one"), (3, None), (4, "..."), (5, " ".join(BASE.split()[30:41])), (6, "ONE, two; three")]


@pytest.mark.parametrize("max_sent", [1 << 20, 0])
def test_contamination_is_exact(spark, docs, none, max_sent):
    items = spark.createDataFrame([(k, t, "x") for k, t in ITEMS], "item_id long, text string, doc_id string")
    found = by_id(contamination(docs, items, max_sent=max_sent))
    expected = brute_hits(TEXTS, ITEMS)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in (found[i * 3] for i in range(len(TEXTS)))] == expected
    assert contamination(none, items, max_sent=max_sent).count() == 0
    assert not contamination(docs, items.limit(0), max_sent=max_sent).where("contaminated").count()


def test_null_and_repeated_keys_and_identical_rows(spark):
    rows = [(None, BASE), (None, None), (4, BASE), (4, BASE), (5, LINES + "\n" + LINES), (5, LINES + "\n" + LINES)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(None, BASE), (1, None)], "item_id long, text string")
    assert token_counts(df, TOKENIZER).count() == 6
    assert pack_documents(df, TOKENIZER).agg(F.sum("length")).first()[0] == sum(len(whole_ids(t)) + 1 for _, t in rows)
    assert sorted(r.slot for r in shard_documents(df, shards=1).collect()) == list(range(6))
    assert [r.text for r in dedup_lines(df).where("doc_id IS NULL AND text IS NOT NULL").collect()] == [BASE]
    assert {(r.doc_id, r.component_id) for r in jaccard_components(df).collect()} == {(None, 4), (None, None), (4, 4), (5, 5)}
    assert contamination(df, items).where("contaminated").count() == 3
    assert remove_repeats(df).count() == 6
