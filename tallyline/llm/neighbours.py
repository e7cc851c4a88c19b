"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-rotation, three rounds of random signs and a fast Hadamard transform, and hashed to the
signed axis it then lies nearest to. An index has TABLES such hashes (of `functions` rotations each). A query looks up,
in every table, the PROBES axes it lies nearest to, and all candidates are ranked by their exact cosine.

Equal vectors are one entry with its smallest ids, as many as a result can need, so a vector that a third of all rows
share is one candidate. Buckets are dealt out in blocks of at most BLOCK entries and BLOCK queries by their counted sizes;
a task multiplies one block of queries with one block of entries and sends on the best of each query only, so nothing
grows with a bucket and no pairs are formed. Queries that found fewer than `k` are compared with all entries, in blocks.

Defined results: a vector that is NULL, empty, zero, or holds NULL, NaN or an infinity takes no part, nor does a row
without an id. Only vectors of one length are compared. Rows with one id and different vectors are different candidates;
a query is answered for each id once per vector, and never with its own id. Ties go to the smaller id. With fewer than `k`
candidates all come back; an empty table gives an empty table. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.frames import stored

TABLES, PROBES, BLOCK, SEED = 8, 20, 4096, 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(rows, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Rows (padded to a power of two) after the pseudo-rotation of a table's function."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, function, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        y = hadamard(y * s)
    return y


def _axes(y: np.ndarray) -> np.ndarray:
    """Closeness to every signed axis: +e0, +e1, ..., -e0, -e1, ..."""
    return np.concatenate([y, -y], 1)


def codes(x: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """The bucket of each row in every table."""
    out = np.zeros((len(x), tables), np.int64)
    for t in range(tables):
        for f in range(functions):
            axes = _axes(rotated(x, t, f))
            out[:, t] = out[:, t] * axes.shape[1] + axes.argmax(1)
    return out


def probed(x: np.ndarray, tables: int, functions: int, probes: int) -> np.ndarray:
    """The nearest `probes` buckets of each row in every table, by the closeness summed over the table's functions."""
    out = []
    for t in range(tables):
        code, near = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f in range(functions):
            axes = _axes(rotated(x, t, f))
            few = np.argsort(-axes, 1, kind="stable")[:, :probes]
            near = (near[:, :, None] + np.take_along_axis(axes, few, 1)[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * axes.shape[1] + few[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-near, 1, kind="stable")[:, :probes]
            near, code = np.take_along_axis(near, best, 1), np.take_along_axis(code, best, 1)
        out.append(code)
    return np.stack(out, 1)


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the rows of each length."""
    lengths = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy().astype(np.float64), np.append(0, np.cumsum(lengths))
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield at, flat[ends[at][:, None] + np.arange(width)]


def _buckets(vector: Column, work) -> Column:
    """Per table, the buckets of a vector that `work` names, as (table, code) pairs."""
    @F.arrow_udf("array<struct<table:int,code:bigint>>")
    def buckets_of(column: pa.Array) -> pa.Array:
        per: list[np.ndarray | None] = [None] * len(column)
        for at, x in _matrix(column):
            for low in range(0, len(at), 1024):
                got = work(x[low: low + 1024])
                for i, c in zip(at[low: low + 1024], got.reshape(len(got), got.shape[1], -1), strict=True):
                    per[i] = c
        counts = [c.size for c in per]
        tables = np.concatenate([np.repeat(np.arange(c.shape[0]), c.shape[1]) for c in per]) if per else np.zeros(0)
        values = np.concatenate([c.ravel() for c in per]) if per else np.zeros(0)
        pairs = pa.StructArray.from_arrays([pa.array(tables.astype(np.int32)), pa.array(values.astype(np.int64))],
                                           ["table", "code"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pairs)

    return buckets_of(vector)


def _best(k: int):
    kinds = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("mark", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(queries) or not len(entries):
            return kinds.empty_table()
        q = next(_matrix(queries["v"].combine_chunks()))[1]
        v = next(_matrix(entries["v"].combine_chunks()))[1]
        v_norm = np.sqrt(np.einsum("ij,ij->i", v, v))
        ids = entries["ids"].to_pylist()
        first = np.array([i[0] for i in ids])
        keep = min(k + 1, len(v))  # one may hold no id but the query's own
        names, marks = queries["query"].to_pylist(), queries["mark"].to_pylist()
        out: list[tuple] = []
        for low in range(0, len(q), 256):
            part = q[low: low + 256]
            near = (part @ v.T) / v_norm
            edge = np.partition(near, len(v) - keep, axis=1)[:, len(v) - keep]
            for i in range(len(part)):
                # all that reach the last place, with room for rounding; the exact score decides between them
                at = np.flatnonzero(near[i] >= edge[i] - 1e-9 * (1 + abs(edge[i])))
                exact = np.einsum("j,ij->i", part[i], v[at]) / (v_norm[at] * np.sqrt(np.einsum("j,j", part[i], part[i])))
                found = 0
                for j in np.lexsort((first[at], -exact)).tolist():
                    if found >= k and exact[j] < last:
                        break
                    own = [n for n in ids[at[j]] if n != names[low + i]][:k]
                    out += [(names[low + i], n, marks[low + i], float(exact[j])) for n in own]
                    found, last = found + len(own), exact[j]
        return pa.table([pa.array([r[c] for r in out], f.type) for c, f in enumerate(kinds)], schema=kinds)
    return run


def _search(queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The best k of each query within each bucket both sides are in, block by block."""
    bucket = ["width", "table", "code"]
    blocks = lambda df, name: df.groupBy(*bucket).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # The sizes, at most a row for each axis of each table and length of vector, are the side to broadcast. Without the hint the
    # choice falls on queries: their size is estimated before they are exploded to all the buckets they look up, vector included.
    sizes = F.broadcast(blocks(queries, "query_blocks").join(blocks(entries, "entry_blocks"), bucket))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("v", F.lit(3)), F.col(n)).cast("int")
    left = queries.join(sizes, bucket).withColumn("eb", every("entry_blocks")).withColumn(
        "qb", F.pmod(F.xxhash64("query", "mark"), F.col("query_blocks")).cast("int")).select(*bucket, "qb", "eb", "query", "mark", "v")
    right = entries.join(sizes, bucket).withColumn("qb", every("query_blocks")).withColumn(
        "eb", own("entry_blocks")).select(*bucket, "qb", "eb", "ids", "v")
    key = [*bucket, "qb", "eb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        _best(k), "query bigint, vec_id bigint, mark bigint, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
            tables: int = TABLES, probes: int = PROBES, functions: int = 1) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors found for each row that `is_query` names."""
    x = F.col(embedding)
    wide = F.transform(x, lambda e: e.cast("double"))
    fit = F.col(vec_id).isNotNull() & (F.size(x) > 0) & F.forall(
        wide, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(wide, lambda e: e != 0)
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("vec_id"), wide.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # of equal vectors, the k + 1 smallest ids are enough for any query
    some = rows.select("vec_id", "v").distinct().withColumn("nth", F.row_number().over(
        Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    entries = stored(some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn(
        "width", F.size("v")), "entries")
    asking = rows.where("asks").select(F.col("vec_id").alias("query"), F.xxhash64("v").alias("mark"), "v",
                                       F.size("v").alias("width")).distinct()
    at = lambda df, work: df.withColumn("b", F.explode(_buckets(F.col("v"), work))).select(
        "*", "b.table", "b.code").drop("b")
    found = stored(_search(at(asking, lambda m: probed(m, tables, functions, probes)),
                           at(entries, lambda m: codes(m, tables, functions)), k)
                   .groupBy("query", "mark", "vec_id").agg(F.max("score").alias("score")), "found")
    enough = found.groupBy("query", "mark").count().where(F.col("count") >= k)
    short = stored(asking.join(enough, ["query", "mark"], "left_anti"), "short")
    if not short.isEmpty():
        one = {"table": F.lit(-1), "code": F.lit(0).cast("long")}
        found = found.unionByName(_search(short.withColumns(one), entries.withColumns(one), k)).groupBy(
            "query", "mark", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", "vec_id", "score")
