"""Whitened vectors against numpy's eigenvectors, and the solver on matrices with clusters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import whitening as wh


def cases():
    rng = np.random.default_rng(1)
    spin = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    yield "random", np.cov(rng.standard_normal((40, 500)))
    yield "all equal", np.eye(30) * 7.5
    yield "clusters", spin @ np.diag([5.0] * 6 + [5 - 1e-13] * 3 + [4.999] * 4 + list(np.linspace(0, 1, 27))) @ spin.T
    yield "diagonal", np.diag([3.0, 1, 3, 2, 3, 0])
    yield "rank one", np.outer(spin[0], spin[0]) * 1e9
    yield "small", np.array([[2.0, 1], [1, 2]])
    yield "one", np.array([[4.0]])
    yield "nothing", np.zeros((5, 5))
    yield "tiny scale", np.cov(rng.standard_normal((20, 50))) * 1e-200


@pytest.mark.parametrize("name,matrix", list(cases()), ids=lambda c: c if isinstance(c, str) else "")
def test_leading_components(name, matrix):
    k = min(9, len(matrix))
    values, vectors = wh.leading(matrix, 9)
    size = max(np.abs(matrix).max(), np.finfo(float).tiny)
    assert vectors.shape == (k, len(matrix))
    assert np.allclose(values / size, np.linalg.eigvalsh(matrix / size)[::-1][:k], atol=1e-13 * len(matrix))
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    assert np.abs((matrix / size) @ vectors.T - vectors.T * (values / size)).max() < 1e-12 * len(matrix)


def test_sturm_counts():
    d, e, _ = wh.tridiagonal(np.cov(np.random.default_rng(3).standard_normal((25, 60))))
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.linspace(-1, 4, 60)
    assert (wh.counts_below(d, e, shifts) == [(true < s).sum() for s in shifts]).all()


def plain(rows, k=8):
    """id, component -> n, deviation, |whitened|, explained by numpy, for vectors of one width."""
    fit = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in fit], object)
    n, s = len(x), x.sum(0)
    centred = ((n * x - s) / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    w = centred @ vectors / np.sqrt(values)
    return [(i, c + 1, n, int(((n * x[r] - s) ** 2).sum()), abs(w[r, c]), values[c] / np.trace(cov))
            for r, (i, _) in enumerate(fit) for c in range(len(values))]


def test_equals_numpy(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    width = len(rows[0][1])
    rows += [(i, rows[5][1]) for i in range(9000, 9300)]  # many copies of one vector
    rows += [(1, None), (2, [float("nan")] + [0.0] * (width - 1)), (3, [None] * width), (4, [float("inf")] * width),
             (None, rows[8][1]), (5, [0.0] * width), (rows[3][0], rows[4][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"id": F.lit("x"), "n": F.lit(3), "width": F.lit(None), "component": F.lit(1), "w": F.lit(2)}).repartition(5)
    got = wh.whiten(df).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[3], r[4])
    mine = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(plain([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]), key=key)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert np.allclose([m[4] for m in mine], [w[4] for w in want], atol=1e-9)
    assert np.allclose([m[5] for m in mine], [w[5] for w in want], rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_flat_short_empty_and_huge(spark):
    def run(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return sorted(wh.whiten(df).collect(), key=lambda r: (r.vec_id, r.component))

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    one = run([(1, [1.0, 2.0, 3.0])])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (c, 1, 0, None, None, None) for c in (1, 2, 3)]
    # two dimensions that vary together: one component; vectors of another width stay among themselves
    pair = run([(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [3.0, 3.0]), (4, [5.0]), (5, [7.0])])
    assert [r.whitened is None for r in pair] == [False, True] * 3 + [False] * 2
    assert [r.n for r in pair] == [3] * 6 + [2] * 2 and pair[-1].identity_error < 1e-12
    assert sorted(round(r.whitened, 6) for r in pair if r.vec_id > 3) == [-1, 1]
    # exact far beyond 64 bits, and entries at the bound
    huge = run([(i, [float(2**40 * i), float(i % 3), -1e300 * (i % 2)]) for i in range(6)])
    x = [[2**50 * i + 100_000, 1024 * (i % 3) + 100_000, -(2**60) * (i % 2) + 100_000] for i in range(6)]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in huge} == {
        i: sum((6 * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) for i in range(6)}
