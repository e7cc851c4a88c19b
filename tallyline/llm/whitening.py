"""Whitening of embedding vectors along their leading principal components.

1. Entries become whole numbers floor(scale * entry) + offset, so that counts and sums over all rows are exact whatever
   the order in which tasks add them up.
2. Every task centres its rows on the exact mean before it multiplies them, and sends on the upper triangle of its sum of
   products; Spark adds the triangles up by cell. No task sees more than its rows and one matrix of the vectors' width.
3. One task per width solves for the leading components: Householder reflections make the covariance tridiagonal, Sturm
   counts bisect its largest eigenvalues, and inverse iteration finds their vectors, made orthogonal within clusters of
   close eigenvalues. What leaves that task are `components` vectors.
4. Those are sent to all tasks, which project their rows. The covariance of the projected rows is measured on the rows.

Memory and what is sent follow the width of the vectors, never their number: width^2 numbers in a task, components * width
at the driver.

Defined results: a vector that is NULL or holds NULL, NaN or an infinity is left out; a row without an id is not, and comes
back with a NULL id. Rows with one id, and equal vectors, count and come back once each. Vectors of another width are
whitened among themselves, with an `n` of their own; an empty vector has no components and gives no row. Entries beyond
2^60 / scale count as that bound. A component along which the rows do not vary (an eigenvalue under FLAT of the largest)
cannot be scaled to one: its `whitened` is NULL, and identity_error leaves it out; without any variance `explained` is NULL.
A `deviation` of more than 38 digits is NULL. An empty table gives an empty table. Only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import stored

COMPONENTS = 8
FLAT = 1e-11
ROUNDS = 8
_EPS = float(np.finfo(float).eps)
_LIMB = 24


# ---- symmetric eigenproblem ------------------------------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and reflectors of a symmetric matrix brought to tridiagonal form by Householder steps."""
    a = np.array(matrix, np.float64)
    reflectors: list[np.ndarray | None] = []
    off = np.zeros(max(0, len(a) - 1))
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        length = float(np.linalg.norm(v))
        if length == 0 or not np.any(v[1:]):
            off[k] = v[0]
            reflectors.append(None)
            continue
        off[k] = -math.copysign(length, v[0])
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        reflectors.append(v)
    if len(a) > 1:
        off[-1] = a[-1, -2]
    return np.diagonal(a).copy(), off, reflectors


def counts_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each shift: the sign changes of its Sturm sequence."""
    squares = off * off
    least = np.finfo(float).tiny * max(1.0, float(squares.max(initial=0)))
    count, q = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for i, d in enumerate(diagonal.tolist()):
        q = d - shifts - (squares[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, by bisection of Sturm counts."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    index = n - 1 - np.arange(k)
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    slack = 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + np.finfo(float).tiny
    low, high = low - slack, high + slack
    for _ in range(200):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        over = counts_below(diagonal, off, middle) > index
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def _solve(diagonal: list[float], off: list[float], shift: float, right: list[float], least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; a pivot of zero is replaced by `least`."""
    n = len(diagonal)
    upper: list[tuple[float, float, float, float]] = []
    a, b, r = diagonal[0] - shift, off[0] if n > 1 else 0.0, right[0]
    for i in range(n - 1):
        top, under = (a, b, 0.0, r), (off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0, right[i + 1])
        if abs(under[0]) > abs(top[0]):
            top, under = under, top
        pivot = top[0] if abs(top[0]) > least else math.copysign(least, top[0])
        m = under[0] / pivot
        upper.append((pivot, top[1], top[2], top[3]))
        a, b, r = under[1] - m * top[1], under[2] - m * top[2], under[3] - m * top[3]
    upper.append((a if abs(a) > least else math.copysign(least, a), 0.0, 0.0, r))
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        pivot, one, two, r = upper[i]
        x[i] = (r - one * x[i + 1] - two * x[i + 2]) / pivot
    return x[:n]


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) for falling eigenvalues; those of a cluster are made orthogonal in every round."""
    n = len(diagonal)
    size = max(float(np.abs(diagonal).max()) + 2 * float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    rng = np.random.default_rng(5)
    vectors = np.zeros((len(values), n))
    diag, side, shift = diagonal.tolist(), off.tolist(), math.inf
    for j, value in enumerate(values.tolist()):
        shift = min(value, shift - 10 * _EPS * size)  # equal eigenvalues get shifts of their own
        near = vectors[:j][np.abs(values[:j] - value) < 1e-3 * size]
        y = rng.standard_normal(n)
        for _ in range(ROUNDS):
            y = _solve(diag, side, shift, (y / np.linalg.norm(y)).tolist(), _EPS * size)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= near.T @ (near @ y)
            if np.linalg.norm(y) < 1e-8:  # nothing left beside the cluster: another start
                y = rng.standard_normal(n)
        for _ in range(2):
            y -= near.T @ (near @ y)
            y /= np.linalg.norm(y)
        vectors[j] = y
    return vectors


def leading(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    k = min(k, len(covariance))
    scale = float(np.abs(covariance).max(initial=0))
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(len(covariance))[:k]
    diagonal, off, reflectors = tridiagonal(covariance / scale)
    values = largest(diagonal, off, k)
    vectors = inverse_iteration(diagonal, off, values)
    for j in range(len(reflectors) - 1, -1, -1):
        v = reflectors[j]
        if v is not None:
            vectors[:, j + 1:] -= 2 * np.outer(vectors[:, j + 1:] @ v, v)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return values * scale, vectors


# ---- sums over tasks -------------------------------------------------------------------------------------------

def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the rows of each width over zero."""
    lengths = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy(), np.append(0, np.cumsum(lengths))
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        for low in range(0, len(at), 4096):
            part = at[low: low + 4096]
            yield part, flat[ends[part][:, None] + np.arange(width)]


def _whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and the exact sums of a task's rows, per width and dimension."""
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for _, x in _by_width(batch.column("x")):
            n, total = found.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
            safe = int(np.abs(x).max()) * len(x) < 2**62
            found[x.shape[1]] = n + len(x), total + (x if safe else x.astype(object)).sum(0).astype(object)
    for width, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
             pa.array([int(t) for t in total], pa.decimal128(38))], ["width", "dim", "n", "total"])


class Centre:
    """n and exact sums of the rows of one width, and rows less their mean."""

    def __init__(self, n: int, totals: list[int]):
        self.n, self.totals = n, totals
        self.whole = np.array([t // n for t in totals], np.int64)
        self.part = np.array([(t % n) / n for t in totals])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - total)^2 of each row, exactly."""
        totals = np.array(self.totals, object)
        width = x.shape[1]
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.totals)) < 2**62:
            d = np.abs(self.n * x - totals.astype(np.int64))
            high, low = d >> _LIMB, d & ((1 << _LIMB) - 1)
            if width * int(high.max(initial=0)) ** 2 < 2**62 and width < 2**14:
                sums = [(u * v).sum(1).tolist() for u, v in ((high, high), (high, low), (low, low))]
                return [(a << 2 * _LIMB) + (b << _LIMB + 1) + c for a, b, c in zip(*sums, strict=True)]
        return [v if v < 10**38 else None for v in ((self.n * x.astype(object) - totals) ** 2).sum(1).tolist()]


def _products(centres: dict[int, Centre]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The upper triangle of the sum of products of a task's centred rows."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_width(batch.column("x")):
                d = centres[x.shape[1]].centred(x)
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + d.T @ d
        for width, total in sums.items():
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)),
                                              pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["width", "i", "j", "v"])
    return run


def _components(k: int, counts: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        """Eigenvalues and vectors of one width's covariance, from its upper triangle."""
        width = table["width"][0].as_py()
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        covariance = np.zeros((width, width))
        covariance[i, j] = covariance[j, i] = v / counts[width]
        values, vectors = leading(covariance, k)
        trace = float(np.trace(covariance))
        return pa.table({"width": pa.array([width] * len(values), pa.int32()),
                         "component": pa.array(range(1, len(values) + 1), pa.int32()), "eigenvalue": pa.array(values),
                         "explained": pa.array([x / trace if trace else None for x in values.tolist()], pa.float64()),
                         "direction": pa.array(list(vectors), pa.list_(pa.float64()))})
    return run


def _project(centres: dict[int, Centre], scaled: dict[int, np.ndarray], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_width(batch.column("x")):
                centre, w = centres[x.shape[1]], scaled[x.shape[1]]
                out = centre.centred(x) @ w.T  # NaN where a component has no variance
                cells = pa.array(out.ravel(), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)).cast(id_type), pa.array([x.shape[1]] * len(x), pa.int32()),
                     pa.array([centre.n] * len(x), pa.int64()), pa.array(centre.deviations(x), pa.decimal128(38)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(w), pa.int32()), cells)],
                    ["id", "width", "n", "deviation", "w"])
    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every vector and component."""
    spark = vectors.sparkSession
    bound = float(2**60)
    wide = F.transform(F.col(embedding), lambda e: e.cast("double"))
    fit = F.col(embedding).isNotNull() & F.forall(
        wide, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(wide, lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(bound)), F.lit(-bound))) + F.lit(offset))
    rows = vectors.where(F.coalesce(fit, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), whole.cast("array<bigint>").alias("x"))

    sums = rows.select("x").mapInArrow(_whole_sums, "width int, dim int, n bigint, total decimal(38,0)").groupBy(
        "width", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("width", "dim").collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        found.setdefault(r["width"], (r["n"], []))[1].append(int(r["total"]))
    centres = {width: Centre(n, totals) for width, (n, totals) in found.items()}

    model = (rows.select("x").mapInArrow(_products(centres), "width int, i int, j int, v double")
             .groupBy("width", "i", "j").agg(F.sum("v").alias("v")).groupBy("width").applyInArrow(
                 _components(components, {w: c.n for w, c in centres.items()}),
                 "width int, component int, eigenvalue double, explained double, direction array<double>"))
    parts = model.orderBy("width", "component").collect()  # `components` rows for each width
    scaled = {}
    for width in centres:
        own = [r for r in parts if r["width"] == width]
        values, directions = np.array([r["eigenvalue"] for r in own]), np.array([r["direction"] for r in own])
        lively = values > max(FLAT * values[0], 0)
        scaled[width] = directions / np.sqrt(np.where(lively, values, np.nan))[:, None]

    projected = stored(rows.mapInArrow(_project(centres, scaled, pa.int64()),
                                       "id bigint, width int, n bigint, deviation decimal(38,0), w array<double>"), "whitened")
    cell = lambda i: F.get("w", F.lit(i))
    gaps = [F.abs(F.covar_pop(cell(i), cell(j)) - F.lit(float(i == j))) for i in range(components) for j in range(i, components)]
    errors = {r["width"]: r["e"] for r in projected.groupBy("width").agg(F.array_max(F.array(*gaps)).alias("e")).collect()}
    shares = spark.createDataFrame([(r["width"], r["component"], r["explained"], errors[r["width"]]) for r in parts],
                                   "width int, component int, explained double, identity_error double")
    cells = projected.select("id", "width", "n", "deviation", F.posexplode("w").alias("at", "whitened"))
    # `components` rows for each width, whatever the number of vectors
    return cells.withColumn("component", F.col("at") + 1).join(F.broadcast(shares), ["width", "component"]).select(
        F.col("id").alias("vec_id"), "component", "n", "deviation", "whitened", "explained", "identity_error")
