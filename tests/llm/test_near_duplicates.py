"""Near-duplicate groups against brute force over all pairs, and the parts of the method by themselves."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import near_duplicates as nd
from tallyline.llm.components import components
from tallyline.llm.words import Words, utf8

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def plain(docs, size):
    sets = {d: shingle_set(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def family(rng, n, words, changes):
    base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(200)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes + 1)):
            w[rng.randrange(len(w))] = "z" + str(rng.randrange(10**6))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    rng = random.Random(size)
    texts = [None, "", " \n", "a", "A", "a b", "a b c", "b a", "Ä b", "ä b", "a\tB  c "]
    for n, words, changes in ((40, 60, 4), (60, 120, 9), (12, 30, 3), (5, 300, 20)):
        texts += family(rng, n, words, changes)
    texts += texts[20:30]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns(
        {"n": F.lit("x"), "bands": F.lit(1), "rep": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, size, 80).collect()}
    assert got == plain(docs, size)
    kept = nd.keep_one(df, size, 80)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, g in got.items() if g[2]}


def test_missing_and_repeated_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    df = spark.createDataFrame([(None, a), (3, a), (3, b), (9, b), (8, a), (3, a), (None, None)], "doc_id long, text string")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in nd.near_duplicates(df, 2, 80).collect())
    assert got == [(-1, 0, -1, True), (-1, 39, -1, True), (3, 39, 3, True), (3, 39, 3, True), (3, 39, 3, True),
                   (8, 39, 3, False), (9, 39, 3, False)]
    assert nd.near_duplicates(df.limit(0), 2, 80).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    errors = []
    for k in (0, 4, 20, 60):
        for _ in range(20):
            other = list(words)
            for i in rng.sample(range(400), k):
                other[i] = f"x{rng.random()}"
            data, offsets = utf8(pa.array([" ".join(words), " ".join(other)]))
            w = Words(data, offsets)
            row, value = nd.shingles(w, 2)
            sig = nd.signatures(row, value, 2)
            assert (sig >> 24 < nd.PLACES).all()
            x, y = shingle_set(" ".join(words), 2), shingle_set(" ".join(other), 2)
            errors.append((sig[0] == sig[1]).mean() - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05
    # every element offers one value to each place, so a single element fills the signature with all ranks
    one = nd.signatures(np.array([0]), np.array([7], np.uint64), 1)[0] >> 24
    assert sorted(one.tolist()) == list(range(nd.PLACES))


def test_bands_miss_a_pair_at_the_threshold_rarely():
    for s in (0.7, 0.8, 0.9):
        r = nd.rows_per_band(s)
        assert (1 - s**r) ** (nd.PLACES // r) <= nd.MISS


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 3), (3, 7), (9, 9)]
    random.Random(2).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 500 for i in range(501, 700)}, 7: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
