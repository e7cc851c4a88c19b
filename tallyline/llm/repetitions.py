"""Runs of repeated words inside a text: all maximal stretches with a smallest period q of at least `power` periods.

A run of period q that holds four multiples of q holds an even one and the two after it, so for every q only every second
place of the grid 0, q, 2q, ... is a candidate, and only where the three words there agree: n log n cheap tests for a text
of n words. Texts with a candidate are compressed to a run-length grammar by recompression, and each candidate is extended
to both sides by a query for the longest common extension in it; a stretch long enough is a run. Octaves of periods are
taken in rising order: a candidate inside a run whose period divides its own would give that run again and is left out.
A stretch found with several periods has the smallest.

Texts are worked on in blocks of bytes; a text is never split, and memory follows the largest text of a task. Nothing is
shuffled. Words are compared by a 64-bit hash.

Defined results: a NULL or empty text, or one without words, has no runs and an empty collapsed text. Rows with one id and
equal texts are answered one by one. An empty table gives an empty table. No other column is read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.recompression import Extensions
from tallyline.llm.words import AS_IS, Hasher, Words, blocks, ragged

LEAST_WORDS, POWER = 6, 4
_HASHER = Hasher(AS_IS, seed=83)
_WORD = re.compile("[^\x20\x09-\x0d]+")
_RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"struct<n_words:bigint,runs:array<{_RUN}>,top:{_RUN},collapsed:string>"


def candidates(words: np.ndarray, first: np.ndarray, counts: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) for periods in [low, 2 * low): every second grid place whose word comes again at the next two."""
    fit = np.flatnonzero(counts >= max(LEAST_WORDS, POWER * low))
    n_periods = np.minimum(2 * low - 1, counts[fit] // POWER) - low + 1
    period = low + ragged(n_periods)
    per_text = (np.repeat(counts[fit], n_periods) - 1) // period // 2
    base = np.repeat(np.repeat(first[fit], n_periods), per_text)
    period = np.repeat(period, per_text)
    place = base + 2 * period * ragged(per_text)
    same = words[place] == words[place + period]
    place, period = place[same], period[same]
    same = words[place + period] == words[place + 2 * period]
    return place[same], period[same]


def octaves(counts: np.ndarray) -> Iterator[int]:
    low = 1
    while POWER * low <= int(counts.max(initial=0)):
        yield low
        low *= 2


def _inside(place: np.ndarray, period: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which candidates lie in the known run (start, end, period) that reaches furthest from before them, and repeat it."""
    if not len(known):
        return np.zeros(len(place), bool)
    known = known[np.argsort(known[:, 0], kind="stable")]
    furthest = np.maximum.accumulate(known[:, 1])
    leads = np.maximum.accumulate(np.where(known[:, 1] == furthest, np.arange(len(known)), 0))
    at = np.searchsorted(known[:, 0], place, "right") - 1
    run = known[leads[np.maximum(at, 0)]]
    return (at >= 0) & (run[:, 1] > place + 2 * period) & (period % run[:, 2] == 0)


def find(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of consecutive texts as rows (text, start, length, period), by text, start and period."""
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    asked = np.zeros(len(counts), bool)
    for low in octaves(counts):
        asked[owner[candidates(words, first, counts, low)[0]]] = True
    if not asked.any():
        return np.zeros((0, 4), np.int64)
    # the texts with candidates one after the other, each behind a symbol of its own
    texts = np.flatnonzero(asked)
    size = counts[texts]
    begin = np.cumsum(size + 1) - size
    ids = np.unique(words, return_inverse=True)[1]
    line = np.empty(int((size + 1).sum()), np.int64)
    line[begin - 1] = len(ids) + np.arange(len(texts))
    line[np.repeat(begin, size) + ragged(size)] = ids[np.repeat(first[texts], size) + ragged(size)]
    extensions = Extensions(line)
    known = np.zeros((0, 3), np.int64)
    for low in octaves(size):
        place, period = candidates(line, begin, size, low)
        new = ~_inside(place, period, known)
        place, period = place[new], period[new]
        start = place - extensions.left(place, place + period)
        end = place + period + extensions.right(place, place + period)
        long = end - start >= np.maximum(LEAST_WORDS, POWER * period)
        known = np.concatenate((known, np.stack((start, end, period), 1)[long]))
        order = np.lexsort((known[:, 2], known[:, 1], known[:, 0]))
        known = known[order]
        known = known[np.append(True, (known[1:, :2] != known[:-1, :2]).any(1))[: len(known)]]
    text = np.searchsorted(begin, known[:, 0], "right") - 1
    out = np.stack((texts[text], known[:, 0] - begin[text], known[:, 1] - known[:, 0], known[:, 2]), 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _highest(runs: np.ndarray) -> np.ndarray:
    """The run (start, length, period) with the greatest length / period, ties to the smaller start, then period."""
    near = runs[:, 1] / runs[:, 2]
    top = runs[near >= near.max() * (1 - 1e-12)]
    best = max(range(len(top)), key=lambda i: (Fraction(int(top[i, 1]), int(top[i, 2])), -top[i, 0], -top[i, 2]))
    return top[best]


def _joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes and the n + 1 offsets."""
    data = words.data
    out, mark = data.copy(), np.zeros(len(data) + 1, np.int8)
    kept = np.flatnonzero(keep)
    mark[words.starts[kept]] += 1
    mark[words.ends[kept]] -= 1
    stay = np.cumsum(mark[:-1]) > 0
    # a space after each kept word but the last of its text, in the place of the byte that follows the word
    text = np.searchsorted(words.first, kept, "right") - 1
    follow = words.ends[kept[:-1][text[1:] == text[:-1]]]
    out[follow] = 0x20
    stay[follow] = True
    return out[stay], np.append(0, np.cumsum(stay))[words.offsets]


def _strings(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    offsets, base = [np.zeros(1, np.int64)], 0
    for _, ends in parts:
        offsets.append(ends[1:] + base)
        base += int(ends[-1])
    data = np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, np.uint8)
    ends = np.concatenate(offsets).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))


def _run_structs(runs: np.ndarray, mask: np.ndarray | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, c])) for c in range(3)],
                                      ["start", "length", "period"], mask=None if mask is None else pa.array(mask))


def found(texts: pa.Array) -> pa.StructArray:
    """n_words, runs, top and collapsed of every text of an Arrow column."""
    counts, runs, per_text, tops, none, joined = [], [], [], [], [], []
    for _, _, data, offsets in blocks(texts):
        words = Words(data, offsets)
        here = find(words.hashes(_HASHER), words.counts)
        n = np.bincount(here[:, 0], minlength=len(words.counts))
        top = np.zeros((len(n), 3), np.int64)
        for part in np.split(here, np.cumsum(n)[:-1]) if len(here) else ():
            if len(part):
                top[part[0, 0]] = _highest(part[:, 1:])
        gone = np.zeros(len(words) + 1, np.int64)
        place = words.first[here[:, 0]] + here[:, 1]
        np.add.at(gone, place + here[:, 3], 1)
        np.add.at(gone, place + here[:, 2], -1)
        joined.append(_joined(words, np.cumsum(gone[:-1]) == 0))
        counts.append(words.counts)
        runs.append(here[:, 1:])
        per_text.append(n)
        tops.append(top)
        none.append(n == 0)
    if not counts:
        counts, per_text, none = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        runs, tops = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    ends = np.append(0, np.cumsum(np.concatenate(per_text))).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(counts).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), _run_structs(np.concatenate(runs))),
         _run_structs(np.concatenate(tops), np.concatenate(none)), _strings(joined)], ["n_words", "runs", "top", "collapsed"])


def repetitions(text: Column) -> Column:
    """A struct of a text's n_words, its runs by start and period, the run of the highest power (`top`, NULL without runs),
    and `collapsed`: its words joined by one space without those that lie in a run after its first period."""
    @F.arrow_udf(FOUND)
    def runs_of(texts: pa.Array) -> pa.Array:
        return found(texts)

    return runs_of(text)


def periodic(doc_id: Column, text: Column) -> Column:
    """The text with repeats written into it where a hash of the id says so (see `digests`); other texts as they are."""
    def rewritten(key: int, words: list[str]) -> str:
        n, g = len(words), key // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return " ".join(words[:a] + (words[a: a + p] * -(-(n - a) // p))[: n - a])

    @F.arrow_udf("string")
    def periodic_text(ids: pa.Array, texts: pa.Array) -> pa.Array:
        keys = [1 if i is None else zlib.crc32(str(i).encode()) for i in ids.to_pylist()]
        changed = {}
        for row in [r for r, key in enumerate(keys) if key % 10 == 0]:
            words = _WORD.findall(texts[row].as_py() or "")
            if words:
                changed[row] = rewritten(keys[row], words)
        if not changed:
            return texts
        mask = np.zeros(len(keys), bool)
        mask[list(changed)] = True
        return pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(list(changed.values()), texts.type))

    return periodic_text(doc_id, text)


def digests(documents: DataFrame) -> DataFrame:
    """The runs of every document as digests, after repeats have been written into one document of ten.

    With h the CRC-32 of the decimal doc_id and g = h // 10: where h % 10 = 0 and the text has words, each word i from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8). A row without doc_id is left as it is.
    """
    r = documents.select("doc_id", repetitions(periodic(F.col("doc_id"), F.col("text"))).alias("r"))
    line = lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","),
                              x["period"].cast("string"), F.lit("\n"))
    return r.select(
        "doc_id", F.size("r.runs").cast("long").alias("n_runs"), "r.top.start", "r.top.length", "r.top.period",
        F.expr("1000 * r.top.length div r.top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("r.runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("r.collapsed", 256).alias("collapsed_sha256"), "r.n_words")
