"""Words, quality rules and shards against plain Python."""

import re
import zlib

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tallyline.llm import quality, sharding
from tallyline.llm.words import Hasher, Words, blocks, utf8, window_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " ", "\n\n", "a", "a b a b a b c", "x\ny\nx\n\nx ", "é ü\x0bß z", "# | <b>", "w " * 400, "q" * 3000,
       "one two three\nfour\none two three\n", "   lead and trail   \n"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD * 2)] + [(None, "no id")],
                                "doc_id long, text string")
    return real.select("doc_id", "text").unionByName(odd).withColumns({"_m": F.lit(1), "shard": F.lit("x")})


def test_words_and_windows_match_regex():
    texts = [t for t in ODD]
    for limit in (1, 30, 1 << 20):
        seen = []
        for _, _, data, offsets in blocks(pa.array(texts), limit):
            w = Words(data, offsets)
            raw = data.tobytes()
            spans = [raw[s:e].decode() for s, e in zip(w.starts, w.ends, strict=True)]
            seen += [spans[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert seen == [WORD.findall(t or "") for t in texts]
    data, offsets = utf8(pa.array(["p q r s t u p q r s t"] * 2))
    w = Words(data, offsets)
    h = w.hashes(Hasher())
    for size in (1, 2, 3, 5, 7):
        got = window_hashes(h, size)
        row, at = w.windows(size)
        words = WORD.findall("p q r s t u p q r s t")
        keys = [tuple(words[i: i + size]) for _ in range(2) for i in range(len(words) - size + 1)]
        assert len({(k, g) for k, g in zip(keys, got[at].tolist(), strict=True)}) == len(set(keys))
    assert len(set(Hasher().spans(*(lambda d: (d, w.starts, w.ends))(data)).tolist())) == 6


def test_long_words_hash_alike():
    big = "z" * 700_000
    data, offsets = utf8(pa.array([big, "y " + big, big + "z"]))
    h = Words(data, offsets).hashes(Hasher())
    assert h[0] == h[2] and h[3] != h[0]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    raw = text.encode()
    packer = zstandard.ZstdCompressor(level=quality.ZSTD_LEVEL)
    ok = quality.compression(raw, packer)[3]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), failed,
            ok and not failed)


def test_quality_equals_plain_python(docs):
    got = quality.verdicts(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    mine = sorted([(r[0], *r[1:8]) for r in got], key=key)
    assert mine == sorted([(d, *plain(t)) for d, t in texts], key=key)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in got) > 10
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_bands():
    packer = zstandard.ZstdCompressor(level=3)
    import random

    rng = random.Random(3)
    noise = bytes(rng.randrange(33, 127) for _ in range(20_000))
    assert not quality.compression(noise, packer)[3]
    assert not quality.compression(b"buy now cheap " * 300, packer)[3]
    assert quality.compression(b"", packer) == (0.0, 0, 0, True)


def test_noise_is_rejected_at_every_length(sf):
    import base64
    import random
    import string

    packer, rng = zstandard.ZstdCompressor(level=3), random.Random(8)

    def base64_lines(n):
        coded = base64.b64encode(rng.randbytes(n)).decode()
        return "\n".join(coded[i: i + 76] for i in range(0, n, 76)).encode()[:n]

    def random_words(n):
        return " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(2, 9)))
                        for _ in range(n // 2)).encode()[:n]

    import pyarrow.parquet as pq
    texts = [t.encode() for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() if t]
    usual = [t for t in texts if quality.compression(t, packer)[3] and len(t) > 1000]
    prose = b" ".join(usual[:60])
    assert len(prose) > 60_000 and len(usual) > 20
    for n in (300, 512, 700, 1024, 1500, 2048, 2049, 2500, 3071, 4000, 8192, 20_001, 100_000):
        assert not quality.compression(base64_lines(n), packer)[3], n
        assert not quality.compression(random_words(n), packer)[3], n
    for n in (2500, 3000, 4000, 8192, 20_001, 100_000):
        for share in (0.5, 0.6):
            noise = base64_lines(int(n * share))
            mixed = prose[: n - len(noise)] + b"\n" + noise
            assert not quality.compression(mixed, packer)[3], (n, share)


def test_clean_labelled_texts_are_above_the_low_limits(sf):
    import pyarrow.parquet as pq

    packer = zstandard.ZstdCompressor(level=3)
    good = {r["doc_id"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r["quality"] == 1}
    texts = [r["text"].encode() for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
             if r["doc_id"] in good and len(r["text"].split()) >= quality.MIN_WORDS]
    assert len(texts) > 20 and all(len(t) / len(packer.compress(t)) >= quality.limits(len(t))[0] for t in texts)


def test_shards_are_contiguous_equal_and_complete(docs):
    got = sharding.shard_by_bytes(docs, 8).collect()
    want = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)
                  for d, t in docs.select("doc_id", "text").collect())
    mine = sorted((r.shard, r.slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in got)
    assert [m[2:] for m in mine] == want
    total, at = sum(w[3] for w in want), 0
    for w, m in zip(want, mine, strict=True):
        assert m[0] == min(7, (2 * at + w[3]) * 8 // (2 * total))
        at += w[3]
    for s in range(8):
        assert [m[1] for m in mine if m[0] == s] == list(range(sum(m[0] == s for m in mine)))
    assert sharding.shard_by_bytes(docs.limit(0), 8).count() == 0


def test_bands_reject_junk_and_leave_clean_texts_alone():
    """On sf0.01: of labelled texts that pass the base rule, most junk goes by its ratio and hardly any clean text does."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [r for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in label]
    found = quality.measure(pa.array([r["text"] for r in rows])).to_pylist()
    kept: dict[int, list[bool]] = {0: [], 1: []}
    for r, m in zip(rows, found, strict=True):
        if m["n_words"] >= quality.MIN_WORDS and 100 * m["n_repeat_words"] <= quality.MAX_REPEAT_PERCENT * m["n_words"]:
            kept[label[r["doc_id"]]].append(m["band_ok"])
    assert len(kept[0]) >= 15 and sum(kept[0]) < 0.4 * len(kept[0])
    assert len(kept[1]) > 200 and sum(not k for k in kept[1]) < 0.01 * len(kept[1])
