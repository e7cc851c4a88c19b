"""Shuffling numbers in bulk: a task sorts its entries by bucket and sends one row of binary columns per bucket.

A bucket is a range of hash values. There are BUCKETS_PER_PARTITION of them for every shuffle partition, so a bucket's
entries shrink as the number of partitions is raised with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

BUCKETS_PER_PARTITION = 2


def bucket_count(spark: SparkSession) -> int:
    return BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of 64-bit hashes, by their upper half."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The entries of each bucket that has any."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, at in zip(np.split(order, cuts), np.append(0, cuts), strict=True):
        yield int(bucket[at]), {k: v[part] for k, v in columns.items()}


def packed(values: np.ndarray, packer: zstandard.ZstdCompressor | None = None) -> bytes:
    """Numbers as a compressed cell: first the low bytes of all, then the next, so that empty high bytes cost nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return (packer or zstandard.ZstdCompressor(level=1)).compress(planes.tobytes())


def unpacked(cell: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(cell), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def rows(columns: list[dict[str, object]], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a schema; arrays become packed cells."""
    packer = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_pylist(
        [{k: packed(v, packer) if isinstance(v, np.ndarray) else v for k, v in row.items()} for row in columns], schema)


def gathered(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The packed columns of all rows, one after the other, as arrays of the given kinds; and each row's lengths."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        for k, kind in kinds.items():
            parts[k] += [unpacked(x, kind) for x in batch.column(k).to_pylist()]
    whole = {k: np.concatenate(parts[k]) if parts[k] else np.zeros(0, kind) for k, kind in kinds.items()}
    return whole, {k: np.array([len(x) for x in parts[k]], np.int64) for k in kinds}


def runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, where each run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)

