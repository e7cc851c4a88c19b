"""Quality rules by compression bands.

The zstandard ratio (bytes in / bytes out) of a text says how predictable it is. Repetitive text compresses far better
than prose of its length, noise far worse; what is usual depends on the length, because a compressor needs some text to
learn from. So every length band has its own limits, for the whole text and for fixed chunks of it: a page of prose with
one repeated block in it can look usual as a whole, but not chunk by chunk.

Defined results: a NULL text counts as empty; an empty text has ratio 0, no chunk and no words, and passes the bands
(the base rule rejects it for its few words). Rows are judged one by one, so repeated rows and ties get equal results
and an empty table gives an empty table. Very long texts are compressed as a stream of their own bytes, never cut off.
The result is one struct column; the input's other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import fresh_name
from tallyline.llm.words import Hasher, Words, blocks, mix, ragged, window_hashes

CHUNK_BYTES = 2048
ZSTD_LEVEL = 3
#: Length bands: (bytes up to, lowest ratio, highest ratio). Longer than the last: LONGEST.
#: Fixed values, read off labelled clean texts in half octaves of length. Highest ratios lie just above what all but one
#: in 200 clean texts reach (1.91 at 512 bytes, 2.04 at 1,448, 2.16 at 2,896, 2.28 at 5,793, 2.38 at 11,585, 2.45 at 23,170,
#: 2.53 at 46,341); junk of scrambled letters and symbols repeats itself and lies above. Lowest ratios lie between what random
#: letters and digits reach (1.09 at 256 bytes, 1.24 at 512, 1.32 at 1,024, 1.37 at 2,048, 1.40 at any length) and the lowest
#: of clean texts (1.34 at 362 bytes, 1.53 at 1,024, 1.77 at 2,048, 1.91 at 4,096, 2.16 at 11,585, 2.27 at any length above).
BANDS = ((256, 1.15, 2.5), (362, 1.2, 1.86), (512, 1.28, 1.88), (724, 1.36, 1.92), (1024, 1.42, 1.99), (1448, 1.52, 2.05),
         (2048, 1.6, 2.11), (2896, 1.66, 2.18), (4096, 1.72, 2.23), (5793, 1.76, 2.3), (8192, 1.85, 2.35), (11585, 1.9, 2.4),
         (16384, 1.95, 2.44), (23170, 2.0, 2.47), (32768, 2.0, 2.51), (46341, 2.0, 2.55), (65536, 2.0, 2.6))
LONGEST = (2.0, 2.8)
#: A chunk's own limits, and the share of a text's chunks that may be outside them.
CHUNK_LIMITS, CHUNK_SHARE = (1.6, 2.3), 0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

MEASURES = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
            "ratio:double,n_chunks:bigint,odd_chunks:bigint,band_ok:boolean>")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HASHER = Hasher(seed=9)
_ROW = np.uint64(0x9E3779B97F4A7C15)


def limits(n_bytes: int) -> tuple[float, float]:
    """The lowest and highest ratio usual for a text of so many bytes."""
    for most, low, high in BANDS:
        if n_bytes <= most:
            return low, high
    return LONGEST


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside their limits, and whether the text is within its band."""
    if not text:
        return 0.0, 0, 0, True
    ratio = len(text) / len(packer.compress(text))
    low, high = limits(len(text))
    ok = low <= ratio <= high
    n = -(-len(text) // CHUNK_BYTES)
    if n == 1:
        return ratio, 1, int(not ok), ok
    odd = 0
    for i in range(n):
        at = min(i * CHUNK_BYTES, len(text) - CHUNK_BYTES)  # the last chunk is the last whole chunk's bytes
        part = text[at: at + CHUNK_BYTES]
        odd += not CHUNK_LIMITS[0] <= len(part) / len(packer.compress(part)) <= CHUNK_LIMITS[1]
    return ratio, n, odd, ok and odd <= CHUNK_SHARE * n


def _keyed(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(hashes + rows.astype(np.uint64) * _ROW)


def _line_repeats(words: Words) -> np.ndarray:
    """Per text, its lines with a word that equal an earlier line."""
    data, offsets = words.data, words.offsets
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # lines of a text: from its start or after a break, to the next break or its end
    per = np.searchsorted(breaks, offsets)
    n = np.diff(per) + 1
    owner = np.repeat(np.arange(rows), n)
    k = ragged(n)
    at = np.repeat(per[:-1], n) + k
    padded = np.append(breaks, 0)
    starts = np.where(k == 0, offsets[owner], padded[at - 1] + 1)
    ends = np.where(k == np.repeat(n, n) - 1, offsets[owner + 1], padded[np.minimum(at, len(breaks))])
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owner = starts[full], ends[full], owner[full]
    distinct = np.unique(_keyed(_HASHER.spans(data, starts, ends), owner), return_index=True)[1]
    return np.bincount(owner, minlength=rows) - np.bincount(owner[distinct], minlength=rows)


def _repeat_words(words: Words) -> np.ndarray:
    """Per text, its words inside three-word windows that occur twice or more in it."""
    rows = len(words.counts)
    row, at = words.windows(3)
    if not len(at):
        return np.zeros(rows, np.int64)
    key = _keyed(window_hashes(words.hashes(_HASHER), 3)[at], row)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.append(same, False) | np.insert(same, 0, False)
    covered = np.zeros(len(words), bool)
    hit = at[order[again]]
    for k in range(3):
        covered[hit + k] = True
    return np.bincount(words.owners()[covered], minlength=rows)


def measure(texts: pa.Array) -> pa.StructArray:
    """The MEASURES of every text of an Arrow column."""
    packer = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    columns: list[list[np.ndarray]] = [[] for _ in range(9)]
    for _, _, data, offsets in blocks(texts):
        words = Words(data, offsets)
        rows = len(offsets) - 1
        # a character is counted at its first byte; words are never split inside a character
        heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        chars = np.append(0, np.cumsum(heads[words.ends] - heads[words.starts]))
        symbols = np.append(0, np.cumsum(_SYMBOL[data]))
        raw = data.tobytes()
        packed = [compression(raw[offsets[i]: offsets[i + 1]], packer) for i in range(rows)]
        ratio, chunks, odd, ok = (np.array(x) for x in zip(*packed, strict=True))
        for column, x in zip(columns, (words.counts, np.diff(chars[words.first]), np.diff(symbols[offsets]),
                                       _line_repeats(words), _repeat_words(words), ratio, chunks, odd, ok), strict=True):
            column.append(x)
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    names = [x.split(":")[0] for x in MEASURES[7:-1].split(",")]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)], names)


def quality(text: Column) -> Column:
    """A struct with the MEASURES of `text`."""
    @F.arrow_udf(MEASURES)
    def quality_measures(texts: pa.Array) -> pa.Array:
        return measure(texts)

    # not to be evaluated once more for a filter on the result
    return quality_measures.asNondeterministic()(text)


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def verdicts(documents: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept, for every row."""
    measured = documents.select("doc_id", quality(F.col("text")).alias("_m"))
    return measured.select(
        "doc_id", *[f"_m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed("_m").alias("base_failed"), (~base_failed("_m") & F.col("_m.band_ok")).alias("kept"),
        "_m.ratio", "_m.n_chunks", "_m.odd_chunks")


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns as they were."""
    m = fresh_name(documents, "_quality")
    return documents.withColumn(m, quality(F.col("text"))).where(~base_failed(m) & F.col(f"{m}.band_ok")).drop(m)
