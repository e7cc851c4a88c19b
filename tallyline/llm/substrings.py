"""Removal of repeated passages by difference-cover anchors.

A cover D modulo a period v holds, for every difference, two members with it. So for any two places i and j of words
there is a k below v with i + k and j + k both at cover positions modulo v: if the same `size` words start at i and at j,
the anchors of size - v + 1 words at i + k and j + k are equal and both are hashed, though only |D| of v positions are.

1. Anchors at cover positions go to buckets by hash; those that occur twice nominate their documents' positions.
2. A nominated match is extended: every window of `size` words around a repeated anchor is hashed with 96 bits and the
   earliest (doc_id, start) of each window wins; the other windows are repeats. Windows without a repeated anchor are
   never looked at, and no pairs of documents are formed.
3. Words covered by a repeat are removed.

Both exchanges fold equal hashes inside the sending task first, so a passage in a third of all documents reaches its
bucket once per task and not once per document.

Defined results: a NULL or short text has no window and is kept as it is. A row without doc_id counts as later than
those with one, in the order of a hash of its text. Rows with one doc_id and different texts are different documents in
the order of that hash; rows equal in both are one document and each gets its result. Ties cannot occur otherwise. Other
columns come through unchanged; one named like a result column gives way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.blobs import bucket_count, bucket_of, by_bucket, gathered, rows, runs
from tallyline.llm.words import Hasher, Words, blocks, mix, window_hashes

SIZE = 20
#: Perfect difference sets: period, positions.
COVERS = ((3, (0, 1)), (7, (0, 1, 3)), (13, (0, 1, 3, 9)), (21, (0, 1, 4, 14, 16)), (31, (0, 1, 3, 8, 12, 18)))
MIN_ANCHOR = 6
FLUSH = 600_000
_WORD, _CHECK = Hasher(seed=41), Hasher(seed=42)
_KNOWN = 2**40 - 1  # stands for "repeated inside the sending task"; no document has this key
_SPOTS = pa.schema([("bucket", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("docs", pa.binary()),
                    ("counts", pa.binary()), ("spots", pa.binary())])
_SPOTS_DDL = "bucket int, low binary, high binary, docs binary, counts binary, spots binary"
_NOMINATED = pa.schema([("to", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("spots", pa.binary())])
_NOMINATED_DDL = "to int, docs binary, counts binary, spots binary"
_WINDOWS = pa.schema([("bucket", pa.int32()), ("h1", pa.binary()), ("h2", pa.binary()), ("docs", pa.binary()),
                      ("ids", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary())])
_WINDOWS_DDL = ("bucket int, h1 binary, h2 binary, docs binary, ids binary, marks binary, counts binary, starts binary")
_REPEATS = pa.schema([("to", pa.int32()), ("docs", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()),
                      ("counts", pa.binary()), ("starts", pa.binary())])
_REPEATS_DDL = "to int, docs binary, ids binary, marks binary, counts binary, starts binary"


def cover(size: int) -> tuple[int, np.ndarray]:
    """Period and positions for windows of `size` words: the sparsest whose anchors keep MIN_ANCHOR words if they can."""
    fit = [c for c in COVERS if size - c[0] + 1 >= min(MIN_ANCHOR, size - 2)]
    if not fit:
        raise ValueError("windows need at least 3 words")
    return fit[-1][0], np.array(fit[-1][1])


def _per_doc(doc: np.ndarray, spot: np.ndarray) -> dict[str, np.ndarray]:
    """Positions in order of document, with the documents once and the number of positions of each."""
    order = np.lexsort((spot, doc))
    begin = runs(doc[order])
    return {"docs": doc[order[begin]], "counts": np.diff(np.append(begin, len(doc))).astype("<u4"),
            "spots": spot[order].astype("<u4")}


def _anchors(size: int, buckets: int):
    period, positions = cover(size)
    width = size - period + 1
    aligned = np.zeros(period, bool)
    aligned[positions] = True

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, doc, spot = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, doc, spot = h[order], doc[order], spot[order]
        begin = runs(h)
        count = np.diff(np.append(begin, len(h)))
        again = np.repeat(count > 1, count)
        # equal anchors of this task are repeats already; their bucket only has to know that the hash exists
        known = [{"bucket": -1 - g, **_per_doc(c["doc"], c["spot"])} for g, c in by_bucket(
            doc[again] % buckets, {"doc": doc[again], "spot": spot[again]})]
        one, key, out = np.where(count > 1, _KNOWN, doc[begin]), h[begin], []
        for b, c in by_bucket(bucket_of(key, buckets), {"key": key, "doc": one, "spot": spot[begin]}):
            order = np.lexsort((c["spot"], c["doc"]))  # as _per_doc has them
            out.append({"bucket": b, "low": c["key"][order].astype("<u4"),
                        "high": (c["key"][order] >> np.uint64(32)).astype(np.uint8), **_per_doc(c["doc"], c["spot"])})
        yield rows(known + out, _SPOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for row, end, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                owner, at = words.windows(width)
                spot = at - words.first[owner]
                on = aligned[spot % period] & (words.counts >= size)[owner]
                if on.any():
                    h = window_hashes(words.hashes(_WORD), width)[at[on]]
                    parts.append((h, docs[row:end][owner[on]], spot[on]))
                    held += len(h)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)
    return run


def _nominate(buckets: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's repeated anchors, dealt out by document; what the senders knew passes through."""
        if key[0].as_py() < 0:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - key[0].as_py()] * len(batch), pa.int32()), *(
                    batch.column(c) for c in ("docs", "counts", "spots"))], schema=_NOMINATED)
            return
        got, _ = gathered(batches, {"low": "<u4", "high": "u1", "docs": "<i8", "counts": "<u4", "spots": "<u4"})
        h = got["low"].astype(np.uint64) | (got["high"].astype(np.uint64) << np.uint64(32))
        order = np.argsort(h)
        begin = runs(h[order])
        count = np.diff(np.append(begin, len(h)))
        doc = np.repeat(got["docs"], got["counts"])[order]
        known = doc == _KNOWN
        # one entry that is known to repeat makes its whole run repeats
        again = np.repeat((count > 1) | (np.add.reduceat(known, begin) > 0), count) & ~known
        doc, spot = doc[again], got["spots"][order][again]
        yield rows([{"to": g, **_per_doc(c["doc"], c["spot"])}
                    for g, c in by_bucket(doc % buckets, {"doc": doc, "spot": spot})], _NOMINATED)
    return run


def _nominated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of a group: its positions from all buckets."""
    got, _ = gathered(batches, {"docs": "<i8", "counts": "<u4", "spots": "<u4"})
    all_ = _per_doc(np.repeat(got["docs"], got["counts"]), got["spots"])
    yield pa.RecordBatch.from_arrays([pa.array(all_["docs"]), _cells(all_["spots"], all_["counts"])], ["doc", "spots"])


def _cells(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """32-bit numbers as a binary cell per run."""
    ends = np.append(0, np.cumsum(counts, dtype=np.int64)) * 4
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)),
                                                            pa.py_buffer(np.ascontiguousarray(values, "<u4"))])


def _first_wins(h1, h2, ids, marks, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, the first of each run of equal windows, and whether an entry (in that order) is a repeat."""
    order = np.lexsort((start, marks, ids, h2, h1))
    begin = runs(h1[order], h2[order])
    count = np.diff(np.append(begin, len(order)))
    head = np.repeat(order[begin], count)
    again = (ids[order] != ids[head]) | (marks[order] != marks[head]) | (start[order] != start[head])
    return order, order[begin], again


def _per_text(docs, ids, marks, start) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order by text, and in it the texts once, the number of starts of each, and the starts."""
    order = np.lexsort((start, marks, ids, docs))
    begin = runs(docs[order], ids[order], marks[order])
    first = order[begin]
    return order, {"docs": docs[first], "ids": ids[first], "marks": marks[first],
                   "counts": np.diff(np.append(begin, len(order))).astype("<u4"), "starts": start[order].astype("<u4")}


def _dealt(docs, ids, marks, start, buckets: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for g, c in by_bucket(docs % buckets, {"docs": docs, "ids": ids, "marks": marks, "start": start}):
        yield g, _per_text(**c)[1]


def _extend(size: int, buckets: int):
    period, _ = cover(size)

    def flush(parts) -> Iterator[pa.RecordBatch]:
        h1, h2, docs, ids, marks, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, again = _first_wins(h1, h2, ids, marks, start)
        hit = order[again]
        out = [{"bucket": -1 - g, **c} for g, c in _dealt(docs[hit], ids[hit], marks[hit], start[hit], buckets)]
        for b, c in by_bucket(bucket_of(h1[first], buckets), {"e": first}):
            e = c["e"]
            order, texts = _per_text(docs[e], ids[e], marks[e], start[e])
            out.append({"bucket": b, "h1": h1[e[order]], "h2": h2[e[order]], **texts})
        yield rows(out, _WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            docs, ids, marks = (batch.column(c).to_numpy() for c in ("doc", "id", "mark"))
            spots = batch.column("spots").to_pylist()
            for row, end, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                # a window is a candidate if a repeated anchor begins in its first `period` words
                mark = np.zeros(len(words) + 1, np.int64)
                for i in range(row, end):
                    at = np.frombuffer(spots[i], "<u4").astype(np.int64)
                    at = at[at < words.counts[i - row]] + words.first[i - row]  # a key shared by two documents
                    mark[at] = 1
                seen = np.append(0, np.cumsum(mark))
                owner, at = words.windows(size)
                on = seen[at + period] > seen[at]
                if on.any():
                    owner, at = owner[on], at[on]
                    rid = row + owner
                    parts.append((window_hashes(words.hashes(_WORD), size)[at],
                                  window_hashes(words.hashes(_CHECK), size, 0x9FB21C651E98DF25)[at].astype(np.uint32),
                                  docs[rid], ids[rid], marks[rid], at - words.first[owner]))
                    held += len(at)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)
    return run


_TEXTS = {"docs": "<i8", "ids": "<i8", "marks": "<i8", "counts": "<u4", "starts": "<u4"}


def _spread(got: dict[str, np.ndarray]) -> list[np.ndarray]:
    return [np.repeat(got[c], got["counts"]) for c in ("docs", "ids", "marks")] + [got["starts"]]


def _decide(buckets: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's repeated windows, dealt out by document; what the senders knew passes through."""
        if key[0].as_py() < 0:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([-1 - key[0].as_py()] * len(batch), pa.int32()), *(
                    batch.column(c) for c in _TEXTS)], schema=_REPEATS)
            return
        got, _ = gathered(batches, {"h1": "<u8", "h2": "<u4", **_TEXTS})
        docs, ids, marks, start = _spread(got)
        order, _, again = _first_wins(got["h1"], got["h2"], ids, marks, start)
        hit = order[again]
        yield rows([{"to": g, **c} for g, c in _dealt(docs[hit], ids[hit], marks[hit], start[hit], buckets)], _REPEATS)
    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per key of a group: the texts with that key and the starts of their repeats."""
    _, texts = _per_text(*_spread(gathered(batches, _TEXTS)[0]))
    begin = runs(texts["docs"])
    ends = pa.array(np.append(begin, len(texts["docs"])), pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(texts["docs"][begin]), *(pa.ListArray.from_arrays(ends, x) for x in (
        pa.array(texts["ids"]), pa.array(texts["marks"]), _cells(texts["starts"], texts["counts"])))],
        ["doc", "ids", "marks", "starts"])


def covered(starts: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which of a text's words lie in a window that begins at one of `starts`."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


def _keep(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_ids, own_marks = (batch.column(c).to_numpy() for c in ("id", "mark"))
            for row, end, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                repeats = [batch.column(c).slice(row, end - row).to_pylist() for c in ("ids", "marks", "starts")]
                raw = data.tobytes()
                gone = np.zeros(len(words), bool)
                kept, joined = [], []
                for i in range(end - row):
                    a, b = words.first[i], words.first[i + 1]
                    starts = [np.frombuffer(s, "<u4") for d, m, s in zip(*(c[i] or () for c in repeats), strict=True)
                              if d == own_ids[row + i] and m == own_marks[row + i]]
                    if starts:
                        gone[a:b] = covered(np.concatenate(starts).astype(np.int64), b - a, size)
                    stay = ~gone[a:b]
                    s, e = words.starts[a:b], words.ends[a:b]
                    joined.append(b" ".join([raw[x:y] for x, y in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]))
                    kept.append(raw[offsets[i]: offsets[i + 1]] if stay.all() else _without(raw, s, offsets[i + 1], stay))
                removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(row, end - row), pa.array(kept, pa.binary()).cast(pa.string()),
                     pa.array(joined, pa.binary()).cast(pa.string()), pa.array(words.counts), pa.array(removed)],
                    ["row", "kept_text", "kept_words", "n_words", "n_removed"])
    return run


def _without(raw: bytes, starts: np.ndarray, end: int, stay: np.ndarray) -> bytes:
    """A text without its removed words and the white space after each of them."""
    stops = np.append(starts[1:], end)
    change = np.flatnonzero(np.diff(np.concatenate(([False], stay, [False])).astype(np.int8)))
    return b"".join([raw[starts[a]: stops[b - 1]] for a, b in zip(change[::2], change[1::2], strict=True)]).rstrip()


def without_repeats(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """Every row as a struct `row`, with kept_text, kept_words (joined by one space), n_words and n_removed."""
    spark = documents.sparkSession
    buckets = bucket_count(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.xxhash64(text)
    late = F.lit(2**62) + F.shiftrightunsigned(mark, 2)
    docs = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), late).alias("id"), mark.alias("mark"),
        # even, so never _KNOWN, and never NULL, so that both joins below read one exchange
        F.xxhash64(F.col("doc_id"), text).bitwiseAND(_KNOWN - 1).alias("doc"), text.alias("text"),
        F.struct(*[c for c in documents.columns if c != "text"]).alias("row"))
    spots = (docs.select("doc", "text").mapInArrow(_anchors(size, buckets), _SPOTS_DDL)
             .groupBy("bucket").applyInArrow(_nominate(buckets), _NOMINATED_DDL)
             .groupBy("to").applyInArrow(_nominated, "doc bigint, spots binary"))
    # both joins deal the texts out by `doc`, so the exchange of the texts is made once
    repeats = (docs.join(spots, "doc").mapInArrow(_extend(size, buckets), _WINDOWS_DDL)
               .groupBy("bucket").applyInArrow(_decide(buckets), _REPEATS_DDL)
               .groupBy("to").applyInArrow(
                   _repeats, "doc bigint, ids array<bigint>, marks array<bigint>, starts array<binary>"))
    row_type = docs.schema["row"].dataType.simpleString()
    return docs.join(repeats, "doc", "left").mapInArrow(
        _keep(size), f"row {row_type}, kept_text string, kept_words string, n_words bigint, n_removed bigint")


def remove_repeats(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents with their texts cut; n_chars, where there is such a column, follows the new text."""
    rest = [F.col(f"row.`{c}`") for c in documents.columns if c not in ("text", "n_chars")]
    made = without_repeats(documents, size).select(
        *rest, F.col("kept_text").alias("text"), F.length("kept_text").cast("long").alias("n_chars"))
    return made.select(*documents.columns)
