"""Scores of whole texts by a gated recurrent language model with a class-factored softmax, trained here.

1. Every training token is counted: tasks fold their counts, send them on by ranges of the word's hash, and the table of
   all counts, one row per bucket, is written to the shared folder. It grows with the corpus and stays there.
2. The network knows the end of a text, a symbol for the tail, and the most frequent other words, up to its SYMBOLS. Its
   outputs start at the shares of the whole corpus, and it learns from every training text. Each scan task trains on its
   own texts; the results are averaged by tokens, in AVERAGED groups first, so that the driver only ever gets that many
   sets of weights (under a megabyte each). TURNS times.
3. All texts are scored whole, with the state carried through. A tail word costs the tail symbol and its share of the
   tail's counts, smoothed as the base score is: so score and base score give every text a probability over the same words.
   Counts of the HEAD most frequent words travel with the code (at most 12 bytes each); the other words of a text are sent
   to their buckets, looked up in the table and returned as sums per text.

Defined results: a NULL or empty text is its end alone. A NULL doc_id is a training text. Repeated rows are counted and
scored as often as they occur. Without training texts nothing is known, and both scores are those of the smoothed empty
counts (0). An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm import recurrent as rnn
from tallyline.llm.blobs import bucket_count, bucket_of, by_bucket, gathered, rows, unpacked
from tallyline.llm.frames import stored
from tallyline.llm.words import LOWER, Hasher, Words, blocks

SMOOTH = 0.1
HEAD = 65_536
TRAIN_SHARE, TURNS, RATE, AVERAGED = 1.0, 1, 0.01, 8
COUNT_FLUSH, TAIL_FLUSH, TEXT_BLOCK = 1_500_000, 1_000_000, 8 << 20  # bytes of text whose lanes run side by side
_WORD = Hasher(LOWER, seed=51)
_LOG10 = np.log(10)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _folded(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(hashes, return_inverse=True)
    return keys, np.bincount(inverse, counts, len(keys)).astype(np.int64)


_COUNTS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("texts", pa.int64()),
                     ("tokens", pa.int64())])
_COUNTS_DDL = "bucket int, words binary, counts binary, texts bigint, tokens bigint"


def _count(buckets: int):
    def flush(parts: list[np.ndarray], texts: int) -> pa.RecordBatch:
        keys, counts = _folded(np.concatenate(parts), np.ones(sum(map(len, parts))))
        out = [{"bucket": b, "words": c["w"], "counts": c["c"], "texts": 0, "tokens": 0}
               for b, c in by_bucket(bucket_of(keys, buckets), {"w": keys, "c": counts})]
        return rows(out + [{"bucket": 0, "words": np.zeros(0, np.uint64), "counts": np.zeros(0, np.int64), "texts": texts,
                            "tokens": 0}], _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, texts = [], 0, 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets)
                parts.append(words.hashes(_WORD))
                held += len(words)
                texts += len(offsets) - 1
                if held >= COUNT_FLUSH:
                    yield flush(parts, texts)
                    parts, held, texts = [], 0, 0
        if texts:
            yield flush(parts, texts)
    return run


def _total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    got, _ = gathered(iter(held), {"words": "<u8", "counts": "<i8"})
    keys, counts = _folded(got["words"], got["counts"])
    texts = sum(sum(b.column("texts").to_pylist()) for b in held)
    yield rows([{"bucket": key[0].as_py(), "words": keys, "counts": counts, "texts": texts, "tokens": int(counts.sum())}],
               _COUNTS)


def word_counts(texts: DataFrame) -> DataFrame:
    """One row per bucket: its words' hashes in order, their counts, and the texts and tokens counted."""
    buckets = bucket_count(texts.sparkSession)
    return stored(texts.select("text").mapInArrow(_count(buckets), _COUNTS_DDL).groupBy("bucket").applyInArrow(
        _total, _COUNTS_DDL), "word_counts")


def _level(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of eight steps an octave."""
    return np.floor(8 * np.log2(counts)).astype(np.int64)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a bucket are on each level, and its totals at level -1."""
    for batch in batches:
        for counts, texts, tokens in zip(*(batch.column(c).to_pylist() for c in ("counts", "texts", "tokens")), strict=True):
            level, n = np.unique(_level(unpacked(counts, "<i8")), return_counts=True)
            zero = np.zeros(len(level), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.append(level, -1), np.append(n, 0), np.append(zero, texts), np.append(zero, tokens))],
                ["level", "words", "texts", "tokens"])


def _tops(lowest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words from a level on."""
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                w, c = unpacked(words, "<u8"), unpacked(counts, "<i8")
                on = _level(c) >= lowest
                yield pa.RecordBatch.from_arrays([pa.array(w[on].view(np.int64)), pa.array(c[on])], ["word", "count"])
    return run


class Known:
    """What every task is given: the head's counts, the totals, and which head words the network knows."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, types: int, texts: int, tokens: int):
        self.ends, self.total, self.types = texts, texts + tokens, types + (texts > 0)
        ranked = np.lexsort((words, -counts))
        symbol = np.full(len(words), rnn.TAIL)
        inner = ranked[: rnn.SYMBOLS - 2]
        symbol[inner] = np.arange(len(inner)) + 2
        order = np.argsort(words)
        self.words, self.counts, self.symbols = words[order], counts[order], symbol[order]
        self.tail_total = tokens - int(counts[inner].sum())
        self.tail_types = types - len(inner)
        self.share = np.full(rnn.SYMBOLS, 1e-9)
        self.share[rnn.END], self.share[rnn.TAIL] = texts + SMOOTH, self.tail_total + SMOOTH
        self.share[2: 2 + len(inner)] = counts[inner]
        self.share /= self.share.sum()

    def base_room(self) -> float:
        return np.log10(self.total + SMOOTH * (self.types + 1))

    def tail_room(self) -> float:
        return np.log10(self.tail_total + SMOOTH * (self.tail_types + 1))

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word in the head, and whether it is there."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return at, self.words[at] == hashes


def known_words(counts: DataFrame) -> Known:
    """The head and the totals. A histogram of counts says from which level on words can be in the head, so that hardly
    more words than those leave their buckets."""
    levels = counts.mapInArrow(_levels, "level bigint, words bigint, texts bigint, tokens bigint").groupBy("level").agg(
        *[F.sum(c).alias(c) for c in ("words", "texts", "tokens")]).orderBy(F.desc("level")).collect()  # under 512 levels
    types, texts, tokens = (sum(r[c] for r in levels) for c in ("words", "texts", "tokens"))
    lowest, seen = 0, 0
    for r in levels:
        if seen < HEAD and r["words"]:
            lowest, seen = r["level"], seen + r["words"]
    head = counts.mapInArrow(_tops(lowest), "word bigint, count bigint").orderBy(F.desc("count"), "word").limit(HEAD).toArrow()
    return Known(head["word"].to_numpy().view(np.uint64), head["count"].to_numpy().astype(np.int64), types, texts, tokens)


def _symbols(words: Words, hashes: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a block as symbols, each with its end; the texts' bounds; place and presence of each word in the head."""
    at, there = known.look_up(hashes)
    symbol = np.where(there, known.symbols[at] if len(known.symbols) else rnn.TAIL, rnn.TAIL)
    bounds = words.first + np.arange(len(words.first))
    out = np.full(int(bounds[-1]), rnn.END)
    out[np.arange(len(words)) + words.owners()] = symbol
    return out, bounds, at, there


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ChunkedArray]:
    """The texts of as many batches as come to TEXT_BLOCK bytes."""
    held: list[pa.Array] = []
    for batch in batches:
        held.append(batch.column("text"))
        if sum(x.nbytes for x in held) >= TEXT_BLOCK:
            yield pa.chunked_array(held)
            held = []
    if held:
        yield pa.chunked_array(held)


def _train(known: Known, weights: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, opt, seen = rnn.shaped(weights), None, 0
        for texts in _together(batches):  # with few texts at a time most lanes run out early
            for _, _, data, offsets in blocks(texts, TEXT_BLOCK):
                words = Words(data, offsets)
                symbols, bounds, _, _ = _symbols(words, words.hashes(_WORD), known)
                opt = opt or rnn.Adam(w, RATE / (1 + turn))
                rnn.train(w, opt, symbols, bounds)
                seen += len(symbols)
        if seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % AVERAGED], pa.int32()), pa.array([float(seen)]),
                                              pa.array([rnn.flat(w).astype("<f4").tobytes()], pa.binary())],
                                             ["group", "tokens", "weights"])
    return run


def _average(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0.0
    for batch in batches:
        for tokens, weights in zip(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            part = np.frombuffer(weights, "<f4").astype(np.float64) * tokens
            total, n = part if total is None else total + part, n + tokens
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([n]), pa.array(
        [(total / n).astype("<f4").tobytes()], pa.binary())], ["group", "tokens", "weights"])


def trained(texts: DataFrame, known: Known) -> np.ndarray:
    """The network's weights after TURNS passes over the texts' share for training."""
    weights = rnn.flat(rnn.start(known.share))
    chosen = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**20)) < int(TRAIN_SHARE * 2**20)).select("text")
    ddl = "group int, tokens double, weights binary"
    for turn in range(TURNS):
        parts = chosen.mapInArrow(_train(known, weights, turn), ddl).groupBy("group").applyInArrow(_average, ddl).collect()
        if parts:
            weights = sum(np.frombuffer(p["weights"], "<f4").astype(np.float64) * p["tokens"] for p in sorted(
                parts, key=lambda p: p["group"])) / sum(p["tokens"] for p in parts)
    return weights.astype(np.float32)


_SCORED = ("key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_sum double, "
           "score_sum double, n_far bigint, bucket int, words binary, docs binary, counts binary")
_KINDS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("base_sum", pa.float64()), ("score_sum", pa.float64()), ("n_far", pa.int64()),
                    ("bucket", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])


def _score(known: Known, weights: np.ndarray, buckets: int):
    base_room, tail_room = known.base_room(), known.tail_room()

    def far(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = []
        for b, c in by_bucket(bucket_of(hashes, buckets), {"h": hashes, "d": docs}):
            order = np.lexsort((c["h"], c["d"]))
            h, d = c["h"][order], c["d"][order]
            begin = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
            out.append({"bucket": b, "words": h[begin], "docs": d[begin], "counts": np.diff(np.append(begin, len(h))).astype("<u4")})
        yield rows(out, _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, key = rnn.shaped(weights), TaskContext.get().partitionId() << 33
        parts, held = [], 0
        for batch in batches:
            for row, end, data, offsets in blocks(batch.column("text"), TEXT_BLOCK):
                words, n = Words(data, offsets), end - row
                hashes = words.hashes(_WORD)
                symbols, bounds, at, there = _symbols(words, hashes, known)
                owner, keys = words.owners(), key + np.arange(n)
                log_count = np.log10((known.counts[at[there]] if len(known.counts) else np.zeros(0)) + SMOOTH)
                near = np.bincount(owner[there], log_count, n)
                tail = there & (known.symbols[at] == rnn.TAIL) if len(known.symbols) else there
                tail_near = np.bincount(owner[tail], np.log10(known.counts[at[tail]] + SMOOTH), n) if tail.any() else np.zeros(n)
                n_tail = np.bincount(owner[~there | tail], minlength=n)
                network = rnn.score(w, symbols, bounds) / _LOG10 if known.total else np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column("doc_id").slice(row, n), batch.column("held_out").slice(row, n),
                     pa.array(words.counts + 1), pa.array(np.bincount(owner[there], minlength=n) + (known.ends > 0)),
                     pa.array(near + np.log10(known.ends + SMOOTH) - (words.counts + 1) * base_room),
                     pa.array(network + tail_near - n_tail * tail_room),
                     pa.array(np.bincount(owner[~there], minlength=n)), pa.nulls(n, pa.int32()),
                     *(pa.nulls(n, pa.binary()) for _ in range(3))], schema=_KINDS)
                key += n
                if not there.all():
                    parts.append((hashes[~there], keys[owner[~there]]))
                    held += len(parts[-1][0])
                if held >= TAIL_FLUSH:
                    yield from far(parts)
                    parts, held = [], 0
        if parts:
            yield from far(parts)
    return run


_SUMS = pa.schema([("to", pa.int32()), ("docs", pa.binary()), ("sums", pa.binary()), ("known", pa.binary())])
_SUMS_DDL = "to int, docs binary, sums binary, known binary"


def _summed(docs: np.ndarray, sums: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, inverse = np.unique(docs, return_inverse=True)
    return keys, np.bincount(inverse, sums, len(keys)), np.bincount(inverse, found, len(keys)).astype(np.int64)


def _answer(buckets: int):
    def run(asked: pa.Table, counts: pa.Table) -> pa.Table:
        """The logarithms of a bucket's counts, summed per text, dealt out by text."""
        if not len(asked):
            return _SUMS.empty_table()
        got, _ = gathered(iter(asked.to_batches()), {"words": "<u8", "docs": "<i8", "counts": "<u4"})
        table, _ = gathered(iter(counts.select(["words", "counts"]).to_batches()), {"words": "<u8", "counts": "<i8"})
        c = np.zeros(len(got["words"]), np.int64)
        if len(table["words"]):
            at = np.minimum(np.searchsorted(table["words"], got["words"]), len(table["words"]) - 1)
            hit = table["words"][at] == got["words"]
            c[hit] = table["counts"][at[hit]]
        n = got["counts"].astype(np.int64)
        docs, sums, found = _summed(got["docs"], n * np.log10(c + SMOOTH), n * (c > 0))
        to = ((docs >> 33) * 31 + (docs & (2**33 - 1)) // 256) % buckets
        return pa.Table.from_batches([rows([
            {"to": g, "docs": x["d"], "sums": x["s"], "known": x["k"].astype("<u4")}
            for g, x in by_bucket(to, {"d": docs, "s": sums, "k": found})], _SUMS)])
    return run


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got, _ = gathered(batches, {"docs": "<i8", "sums": "<f8", "known": "<u4"})
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(got["docs"], got["sums"], got["known"])],
                                     ["key", "far_sum", "far_known"])


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    buckets = bucket_count(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    training = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = word_counts(training)
    known = known_words(counts)
    weights = trained(training, known)
    made = stored(docs.mapInArrow(_score(known, weights, buckets), _SCORED), "scored")
    asked = made.where("bucket is not null").select("bucket", "words", "docs", "counts")
    far = (asked.groupBy("bucket").cogroup(counts.select("bucket", "words", "counts").groupBy("bucket"))
           .applyInArrow(_answer(buckets), _SUMS_DDL)
           .groupBy("to").applyInArrow(_collected, "key bigint, far_sum double, far_known bigint"))
    far_sum = F.coalesce("far_sum", F.lit(0.0))
    return made.where("bucket is null").join(far, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base_sum") + far_sum).alias("base_score"),
        (F.col("score_sum") + far_sum).alias("score"))
