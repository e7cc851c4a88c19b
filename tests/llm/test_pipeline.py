"""The pipeline on the small tables: every decision against plain Python or the operator's own verdict."""

import re
import sys
import zlib
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tallyline.llm import quality, toxicity  # noqa: E402
from tallyline.llm.frames import stored  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), f"test_{name}"))
    return out


def rows(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_stages_are_the_dealt_ones(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "substring_dedup", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_filters_follow_the_verdicts(spark, sf, steps):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id for r in toxicity.scored(steps[0], labels).where("predicted = 0").collect()}
    assert set(rows(steps[1])) == want
    assert set(rows(steps[2])) == {r.doc_id for r in quality.verdicts(steps[1]).where("kept").collect()}
    before = rows(steps[0])
    for step in steps[1:3]:
        assert all(r == before[d] for d, r in rows(step).items())


def test_one_of_each_group_stays(steps):
    docs = sorted((d, shingles(r["text"], 5)) for d, r in rows(steps[2]).items())
    root = {d: d for d, _ in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(docs):
        for b, y in docs[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    assert set(rows(steps[3])) == {d for d in root if top(d) == d}


def test_repeats_are_cut_and_the_rest_is_packed(steps):
    seen, want = {}, {}
    for d, r in sorted(rows(steps[3]).items()):
        words = WORD.findall(r["text"] or "")
        gone = set()
        for i in range(len(words) - 19):
            if seen.setdefault(tuple(words[i: i + 20]), (d, i)) != (d, i):
                gone.update(range(i, i + 20))
        want[d] = [w for i, w in enumerate(words) if i not in gone]
    got = rows(steps[4])
    assert {d: WORD.findall(r["text"]) for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted(((p.doc_id, p.start, p.length, zlib.crc32(p.ids)) for p in steps[5].collect()))
    at = {d: library.encode(r["text"], add_special_tokens=False).ids + [1] for d, r in got.items()}
    assert {d for d, *_ in pieces} == set(at)
    for d, start, length, crc in pieces:
        assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in at[d][start: start + length]))
    assert sum(p[2] for p in pieces) == sum(map(len, at.values()))
