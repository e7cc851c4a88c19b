"""Runs against brute force over all periods, extensions in the grammar against letter by letter, and the digests."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import repetitions as rp
from tallyline.llm.queries import QUERIES
from tallyline.llm.recompression import Extensions

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words):
    """Every maximal stretch with its smallest period, of at least max(6, 4 * period) words, tested word by word."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # periods rise, so the first is the smallest
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *top, None if top[0] is None else 1000 * top[1] // top[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def strings():
    rng = random.Random(7)
    for n in (1, 2, 3, 7, 40, 150):
        for kinds in (1, 2, 3, 30):
            yield [rng.randrange(kinds) for _ in range(n)]
    yield [1, 2, 3] * 40
    yield ([5] * 7 + [2]) * 20 + [5] * 9
    yield ([1, 2] * 6 + [3]) * 5
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b
    base = [rng.randrange(9) for _ in range(25)]
    yield [3, 3] + base * 4 + base[:11] + [4] * 6 + base[5:] * 6


@pytest.mark.parametrize("x", list(strings()), ids=lambda x: str(len(x)))
def test_extensions_and_runs(x):
    rng = np.random.default_rng(1)
    line = np.array(x)
    if len(x) > 1:
        i, j = rng.integers(0, len(x), (2, 300))
        i, j = i[i != j], j[i != j]
        e = Extensions(line)
        for p, q, r, left in zip(i, j, e.right(i, j), e.left(i, j), strict=True):
            k = 0
            while max(p, q) + k < len(x) and x[p + k] == x[q + k]:
                k += 1
            m = 0
            while min(p, q) - m > 0 and x[p - m - 1] == x[q - m - 1]:
                m += 1
            assert (r, left) == (k, m)
    words = np.concatenate((line, line, [77], line)).astype(np.uint64)  # neighbours must not touch
    got = rp.find(words, np.array([len(x), 0, len(x), 1, len(x)]))
    assert [tuple(r) for r in got.tolist()] == [(t, *r) for t in (0, 2, 4) for r in plain_runs(x)]


def test_levels_shrink():
    line = np.random.default_rng(2).integers(0, 400, 20_000)
    assert len(Extensions(line).levels) < 60
    assert len(Extensions(np.zeros(20_000, np.int64)).levels) < 12


def test_whole_table(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in QUERIES["op12_recompression_runs"](spark, sf).collect()}
    assert got == {i: plain(i, t) for i, t in rows.items()}
    assert sum(g[0] > 0 for g in got.values()) > 5


def test_odd_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "Ä b " * 9, "x y z " * 3000, "w " * 5000,
             " ".join(f"v{rng.randrange(3)}" for _ in range(3000)), " b  b\n" * 4, "x\ta b\r\na b\x0ba b a  b "]
    rows = [(i, t) for i, t in enumerate(texts * 6)] + [(None, texts[5]), (3, texts[6]), (3, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"r": F.lit(1), "runs": F.lit("x"), "start": F.lit(None)}).repartition(3)
    got = sorted(tuple(-1 if c is None else c for c in r[:8]) for r in rp.digests(df).collect())
    want = sorted(tuple(-1 if c is None else c for c in (i, *plain(i, t))) for i, t in rows)
    assert got == want and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert rp.digests(df.limit(0)).count() == 0
