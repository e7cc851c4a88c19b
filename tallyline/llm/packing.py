"""Packing of documents into sequences along a space-filling curve.

A document's words are hashed into a signed vector, the vector is projected to DIMS fixed random directions, and its
quantised place in that cube becomes a key on the Hilbert curve: near keys mean near vectors. Documents are range-
partitioned and sorted by (key, doc_id, hash of the text) and encoded there. Token totals per partition give, by a
running sum over one row per partition, the place of every document on one line of tokens, which is cut every `length`
tokens. So a sequence holds neighbours on the curve, only the last sequence is short, and no task sees more than its own
range. Copies of one text share a key but are told apart by doc_id, so a large group of copies is spread over partitions.

Defined results: a NULL text counts as empty; every document ends with `end_id`, so an empty one still has one token. Rows
with a NULL doc_id are packed like others. Repeated rows are packed as often as they occur; rows with one doc_id and
different texts are different documents. An empty table gives no sequence. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.bpe import encoder
from tallyline.llm.encoding import encoded_blocks
from tallyline.llm.frames import stored
from tallyline.llm.words import LOWER, Hasher, Words, blocks

FEATURES, DIMS, BITS = 256, 4, 12
_HASHER = Hasher(LOWER, seed=11)
_DIRECTIONS = np.random.default_rng(7).standard_normal((FEATURES, DIMS))


def vectors(words: Words) -> np.ndarray:
    """Per text, its words hashed into FEATURES signed cells, damped and scaled to length 1; zero without words."""
    rows = len(words.counts)
    h = words.hashes(_HASHER)
    sign = (h >> np.uint64(63)).astype(np.float64) * 2 - 1
    cell = words.owners() * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64)
    v = np.bincount(cell, sign, rows * FEATURES).reshape(rows, FEATURES)
    v = np.sign(v) * np.log1p(np.abs(v))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The Hilbert index of integer points (n, dims) with `bits` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:  # undo the rotations of the curve from the coarsest level down
        low = level - 1
        for i in range(dims):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[-1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(text: Column) -> Column:
    """The place of a text on the curve."""
    @F.arrow_udf("bigint")
    def key_of(texts: pa.Array) -> pa.Array:
        keys = [np.zeros(0, np.int64)]
        for _, _, data, offsets in blocks(texts):
            spot = vectors(Words(data, offsets)) @ _DIRECTIONS  # about normal, with variance 1
            cube = np.clip((spot / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
            keys.append(hilbert(cube, BITS))
        return pa.array(np.concatenate(keys))

    return key_of(text)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, codec = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            row = 0
            for ids, counts in encoded_blocks(batch.column("text"), codec):
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                ends = np.append(0, np.cumsum(counts))
                # the narrow form halves what is stored; ids of larger vocabularies keep four bytes
                width = 2 if len(codec.ids) <= 65536 else 4
                body = pa.Array.from_buffers(pa.binary(), len(counts), [
                    None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, len(counts)), pa.array(np.full(len(counts), part, np.int32)),
                     pa.array(at + ends[:-1]), pa.array(counts), body],
                    ["doc_id", "part", "ahead", "doc_tokens", "ids"])
                at, row = at + int(ends[-1]), row + len(counts)
    return run


def _cut(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                rows = batch.slice(low, 512)
                at = rows.column("place").to_numpy()
                size = rows.column("doc_tokens").to_numpy()
                n = (at + size - 1) // length - at // length + 1
                owner = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                sequence = at[owner] // length + nth
                start = np.maximum(sequence * length, at[owner])
                stop = np.minimum((sequence + 1) * length, (at + size)[owner])
                ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), f"<u{width}").astype("<u4")
                # pieces follow one another as the documents do, so their ends cut the ids as they stand
                ends = np.append(0, np.cumsum(stop - start)) * 4
                body = pa.Array.from_buffers(pa.binary(), len(owner), [
                    None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(owner)), pa.array(start - at[owner]), pa.array(stop - start),
                     pa.array(size[owner]), pa.array(sequence), pa.array(start - sequence * length), body],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return run


def pack(documents: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and ids (32-bit, binary)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    keyed = documents.select("doc_id", "text").select(
        "*", curve_key(F.col("text")).alias("key"), F.xxhash64("text").alias("mark"))
    order = ("key", "doc_id", "mark")
    encoded = (keyed.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
               .select("doc_id", "text")
               .mapInArrow(_encode(path, end_id),
                           f"doc_id {kind}, part int, ahead bigint, doc_tokens bigint, ids binary"))
    line = stored(encoded, "packed_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the range exchange
    bases = line.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")).select(
        "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    placed = line.join(F.broadcast(bases), "part").select(
        "doc_id", "doc_tokens", (F.col("base") + F.col("ahead")).alias("place"), "ids")
    width = 2 if len(encoder(path).ids) <= 65536 else 4
    return placed.mapInArrow(_cut(length, width), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, "
                                                  "sequence_id bigint, offset bigint, ids binary")
