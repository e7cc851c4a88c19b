"""Repeated passages against brute force over all windows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs: list[tuple], size: int) -> dict:
    """(doc_id, text) -> kept words, counting rows with one id and text once."""
    seen, out = {}, {}
    for doc, text in docs:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            key = tuple(words[i: i + size])
            if seen.setdefault(key, (doc, i)) != (doc, i):
                gone.update(range(i, i + size))
        out[doc] = [w for i, w in enumerate(words) if i not in gone], len(words), len(gone)
    return out


@pytest.mark.parametrize("size", [3, 8, 20])
def test_covers_share_an_aligned_anchor(size):
    period, positions = substrings.cover(size)
    on = {int(p) for p in positions}
    assert size - period + 1 >= 1
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in on and (j + k) % period in on for k in range(period))


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "ä", "q"])
    passage = [" ".join(word() for _ in range(n)) for n in (8, 9, 20, 21, 60, 200)]
    out = [None, "", "  ", "one two", passage[3], passage[3], "x " * 300, "x " * 7, passage[2].replace(" ", "\n\t")]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(passage))
        out.append(" ".join(parts) + rng.choice(["", "\n", " "]))
    return out


@pytest.mark.parametrize("size", [3, 8, 20])
def test_equals_brute_force(spark, size):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns(
        {"id": F.lit("i"), "mark": F.lit(1), "row": F.lit(2.5), "kept_text": F.lit("k"), "n_chars": F.lit(1).cast("long")})
    got = {r.row.doc_id: r for r in substrings.without_repeats(df, size).collect()}
    want = plain(docs, size)
    assert set(got) == set(want)
    for d, (kept, n, gone) in want.items():
        assert (got[d].kept_words, got[d].n_words, got[d].n_removed) == (" ".join(kept), n, gone), d
        assert WORD.findall(got[d].kept_text) == kept
    cut = substrings.remove_repeats(df, size)
    assert cut.columns == df.columns
    for r in cut.collect():
        assert r.row == 2.5 and r.kept_text == "k" and r.n_chars == len(r.text) and WORD.findall(r.text) == want[r.doc_id][0]
        if not want[r.doc_id][2]:
            assert r.text == (docs[r.doc_id][1] or "")


def test_flushes_and_buckets_do_not_show(spark, monkeypatch):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substrings, "FLUSH", 50)
    batches = df.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(2**40 - 2).alias("doc"),
                        F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches()
    small = list(substrings._anchors(8, 3)(iter(batches)))
    monkeypatch.setattr(substrings, "FLUSH", 10**9)
    large = list(substrings._anchors(8, 3)(iter(batches)))
    nominated = []
    for sent in (small, large):
        import pyarrow as pa

        table = pa.Table.from_batches(sent)
        found = set()
        for b in set(table["bucket"].to_pylist()):
            rows = table.filter(pa.compute.equal(table["bucket"], b)).to_batches()
            for sent_on in substrings._nominate(3)((pa.scalar(b),), iter(rows)):
                for batch in substrings._nominated(iter([sent_on])):
                    for doc, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        found |= {(doc, s) for s in np.frombuffer(spots, "<u4").tolist()}
        nominated.append(found)
    assert nominated[0] == nominated[1] and nominated[0]


def test_missing_and_repeated_ids(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    other = passage + " and more"
    df = spark.createDataFrame([(None, passage), (5, passage), (5, passage), (7, other), (7, "a b c"), (None, None)],
                               "doc_id long, text string")
    got = sorted(((r.row.doc_id or -1, r.n_words, r.n_removed) for r in substrings.without_repeats(df, 20).collect()))
    assert got == [(-1, 0, 0), (-1, 30, 30), (5, 30, 0), (5, 30, 0), (7, 3, 0), (7, 32, 30)]
    assert substrings.without_repeats(df.limit(0), 20).count() == 0
