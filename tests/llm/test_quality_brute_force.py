"""The quality models against plain counting: n-grams, documents of each bucket, log ratios, weights and what is kept."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from govlens.llm import quality as Q
from govlens.llm.common import utf8

TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x09-\x0d\x20]+")


def shape(tokens, i):
    t = tokens[i]
    if not re.match(rb"[A-Za-z0-9\x80-\xff]", t):
        return ("symbol", t[:3], 0)
    again = 1 if i > 0 and tokens[i - 1] == t else 2 if i > 1 and tokens[i - 2] == t else 0
    small, big, digit = (bool(re.search(p, t)) for p in (rb"[a-z\x80-\xff]", rb"[A-Z]", rb"[0-9]"))
    return ("word", (small, big, digit, b"A" <= t[:1] <= b"Z"), again)


def plain(text):
    """The n-grams of a text in the library's order of kinds."""
    tokens = TOKEN.findall((text or "").encode())
    shapes = [shape(tokens, i) for i in range(len(tokens))]
    out = [("token", k, tuple(tokens[i : i + k])) for k in Q.TOKEN_ORDERS for i in range(len(tokens) - k + 1)]
    return out + [("shape", k, tuple(shapes[i : i + k])) for k in Q.SHAPE_ORDERS for i in range(len(shapes) - k + 1)]


def texts():
    rnd = random.Random(21)
    words = "alpha Beta GAMMA d3lta été one two two three 42 x".split()
    out = [None, "", " \n", "one", "a a a, b!! a b a", "Ünïcode ÉTÉ été 7up", "!?.;:#"]
    for i in range(300):
        pick = [rnd.choice(words) + rnd.choice(["", "", ",", ".", "!!!"]) for _ in range(rnd.randrange(1, 25))]
        out.append(" ".join(pick + ["spam$$$ spam$$$"] * (i % 5 == 0)))
    return out


def test_n_grams_are_the_plain_ones():
    rows = texts()
    number, bucket = Q.features(*utf8(pa.array(rows, pa.string())))
    place = {}
    for i, t in enumerate(rows):
        own, expected = bucket[number == i], plain(t)
        assert len(own) == len(expected)
        for gram, b in zip(expected, own.tolist()):
            assert place.setdefault(gram, b) == b
    assert len(set(place.values())) >= 0.98 * len(place)  # so few n-grams hardly share a bucket


def test_counts_ratios_and_weights_are_the_plain_ones(spark):
    rows = texts()
    target = [i % 5 != 0 and i % 3 != 0 for i in range(len(rows))]
    docs = spark.createDataFrame([(i, t, bool(x)) for i, (t, x) in enumerate(zip(rows, target))], "key long, text string, is_target boolean").repartition(3)
    number, bucket = Q.features(*utf8(pa.array(rows, pa.string())))
    place = {g: b for i, t in enumerate(rows) for g, b in zip(plain(t), bucket[number == i].tolist())}
    raw, good, z = {}, {}, {}
    for t, x in zip(rows, target):
        for b in {place[g] for g in plain(t)}:
            raw[b], good[b] = raw.get(b, 0) + 1, good.get(b, 0) + x
    for kind, k, gram in place:
        z[place[kind, k, gram]] = Q.SHAPE_Z if kind == "shape" else Q.TOKEN_Z[Q.TOKEN_ORDERS.index(k)]
    counted = Q.bucket_counts(docs)
    found = {r.bucket: (r.n_raw, r.n_target) for r in counted.collect()}
    assert found == {b: (raw[b], good[b]) for b in raw} | {-1: (len(rows), sum(target))}
    share, ratio = sum(target) / len(rows), {}
    for b in raw:
        expected = raw[b] * share
        r = math.log((good[b] + Q.PRIOR) / (expected + Q.PRIOR))
        ratio[b] = r if abs(good[b] - expected) >= z[b] * math.sqrt(expected * (1 - share)) and abs(r) >= Q.MIN_RATIO else 0.0
    ratios = Q.log_ratios(counted)
    assert np.count_nonzero(ratios) == sum(r != 0 for r in ratio.values()) > 0
    assert all(math.isclose(ratios[b], r, rel_tol=1e-5, abs_tol=1e-6) for b, r in ratio.items())
    weights = {r.key: (r.log_weight, r.n_grams) for r in Q.log_weights(docs, ratios).collect()}
    for i, t in enumerate(rows):
        assert weights[i][1] == len(plain(t)) and math.isclose(weights[i][0], sum(ratio[place[g]] for g in plain(t)), rel_tol=1e-4, abs_tol=1e-4)


def test_what_is_kept_follows_from_weights_and_lots(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    bad = {i for i, t in enumerate(rows) if t and "spam" in t}
    labels = spark.createDataFrame([(i, int(i not in bad), int(i % 15 == 0 and i in bad)) for i in range(len(rows))], "doc_id long, quality int, toxic int")
    found = Q.select_quality(docs, labels).collect()
    kept = [r for r in found if r.kept]
    assert all(k.sample_key >= r.sample_key for k in kept for r in found if not r.kept)
    assert sum(r.log_weight >= 0 for r in found) <= len(kept)  # the level is at most 1, so what is no less likely is counted
    assert sum(r.doc_id in bad for r in kept) <= 0.05 * len(bad) and sum(r.doc_id not in bad for r in kept) >= 0.95 * (len(rows) - len(bad))
