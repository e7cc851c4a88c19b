"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm import encoding, packing
from tallyline.llm.bpe import Encoder, Merges

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n a", "Hello world's 'shell 're'st   x\t\ty  ", "it's''s \"'s I'M 'S", "'s", "''", "1's 2't", "\n's",
       "<|endoftext|>a<|endoftext|> b <|startoftext|>", "ΑΣ ΟΔΟΣ ΣΣ İstanbul éx Ⅷ ² 123 १२३", "x" * 300 + "=-" * 200,
       "a\u0085b c d \x1c\x1d z", "日本語テキスト、です。🎉🎉👩‍👩‍👧", "  lead", "trail  ", "a\r\n\r\nb", "<|not|> <|",
       "don't can't we'll they've I'd 'tis l'été", "퟿\U0010ffff", "no" * 30 + " " + "ab " * 2000]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate([None, *ODD] * 2)] + [(None, "no id"), (20_000, "x")],
                                "doc_id long, text string")
    return real.select("doc_id", "text").unionByName(odd).withColumns({"key": F.lit(1), "part": F.lit("x")})


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_library(path):
    library, mine = Tokenizer.from_file(path), Encoder(path)
    ids, counts = mine.encode(ODD)
    ends = np.append(0, np.cumsum(counts))
    for i, text in enumerate(ODD):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[ends[i]: ends[i + 1]].tolist() == want, text
    if mine.suffix:
        decoded = mine.decode(ids, counts)
        assert [d.decode() for d in decoded] == [
            library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in ODD]


def test_every_cut_is_forced():
    mine = Encoder(WORDS)
    assert not mine.joined.all() and mine.joined[ord("t"), ord("h")]
    merges = Merges([(1, 1), (2, 1)], [2, 3])
    ids, left = merges.merge(np.array([1] * 7, np.int32), np.array([0, 5]), np.array([5, 2]))
    assert ids.tolist() == [2, 3, 2] and left.tolist() == [2, 1] and merges._one([1] * 5) == [2, 3]


def test_other_files_are_refused(tmp_path):
    text = open(WORDS, encoding="utf-8").read()
    other = tmp_path / "other.json"
    other.write_text(text.replace('"Lowercase"', '"Strip"'), encoding="utf-8")
    with pytest.raises(ValueError):
        Encoder(str(other))


def test_digests_and_columns(docs):
    library = Tokenizer.from_file(WORDS)
    rows = docs.select("text", encoding.round_trip_digests(F.col("text"), WORDS).alias("c"),
                       encoding.token_ids(F.col("text"), WORDS).alias("ids")).select(
        "*", encoding.decoded_text(F.col("ids"), WORDS).alias("back")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.ids == ids and r.back == text and r.c.n_tokens == len(ids)
        assert r.c.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.c.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pieces_rebuild_every_document(docs):
    library = Tokenizer.from_file(BYTES)
    pieces = packing.pack(docs, BYTES, length=64)
    rows = pieces.withColumn("crc", F.crc32("ids")).orderBy("sequence_id", "offset").collect()
    at = 0
    for r in rows:  # the line of tokens has no gap, and every sequence but the last is full
        assert r.sequence_id * 64 + r.offset == at and 0 < r.length <= 64 and len(r.ids) == 4 * r.length
        assert r.crc == zlib.crc32(r.ids)
        at += r.length
    built: list[tuple] = []
    for r in rows:
        if r.start == 0:
            built.append((r.doc_id, r.doc_tokens, []))
        assert built[-1][0] == r.doc_id and len(built[-1][2]) == r.start
        built[-1][2].extend(np.frombuffer(r.ids, "<u4").tolist())
    want = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in docs.select("doc_id", "text").collect()]
    key = repr
    assert sorted(((d, i) for d, _, i in built), key=key) == sorted(want, key=key)
    assert all(n == len(i) for _, n, i in built)
    assert packing.pack(docs.limit(0), BYTES).count() == 0


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cube = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert(cube, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cube[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
