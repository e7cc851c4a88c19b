"""Encoding and decoding of whole texts by a public tokenizer's file; see bpe.py for the method.

Defined results: NULL and empty texts have no ids and decode to an empty text. Strings of special tokens inside a text
become their ids, as in the library. Every row is encoded by itself, so repeated rows agree, and no column but the text
is read. The file's path is a parameter and must be readable on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.llm.bpe import Encoder, encoder
from tallyline.llm.words import blocks


#: Bytes encoded together: larger than a block of words, so that fragments of one length are merged in larger squares.
ENCODED_TOGETHER = 2 << 20


def encoded_blocks(texts: pa.Array, codec: Encoder) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ids per row) of consecutive blocks of rows."""
    for row, end, _, _ in blocks(texts, ENCODED_TOGETHER):
        yield codec.encode([t or "" for t in texts.slice(row, end - row).to_pylist()])


def token_ids(text: Column, path: str) -> Column:
    """The ids of a text."""
    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        parts = list(encoded_blocks(texts, encoder(path)))
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))

    return ids_of(text)


def decoded_text(ids: Column, path: str) -> Column:
    """The text of ids, for files without a decoder of their own: the tokens joined by a space."""
    @F.arrow_udf("string")
    def text_of(rows: pa.Array) -> pa.Array:
        counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array([t.decode() for t in encoder(path).decode(rows.flatten().to_numpy(), counts)], pa.string())

    return text_of(ids)


def round_trip_digests(text: Column, path: str) -> Column:
    """n_tokens, and the SHA-256 of the ids (little-endian, 32 bits) and of the text decoded from them.

    Digests are taken where the ids are, block by block, so ids and decoded texts of a batch are never held at once.
    """
    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests_of(texts: pa.Array) -> pa.Array:
        codec = encoder(path)
        numbers, ids_sha, text_sha = [], [], []
        for ids, counts in encoded_blocks(texts, codec):
            raw = ids.astype("<u4").tobytes()
            ends = np.append(0, np.cumsum(counts * 4)).tolist()
            ids_sha += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            text_sha += [hashlib.sha256(t).hexdigest() for t in codec.decode(ids, counts)]
            numbers += counts.tolist()
        return pa.StructArray.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests_of(text)
