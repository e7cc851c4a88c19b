"""Nearest vectors against exact search, and the transform by its matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import neighbours as nb


def exact(rows, k, asks):
    fit = [(i, np.array(v, float)) for i, v in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in fit:
        if asks(q):
            near = sorted((-float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)), i) for i, y in fit
                          if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_hadamard_and_rotation():
    m = nb.hadamard(np.eye(8))
    assert np.allclose(m @ m.T, np.eye(8)) and np.allclose(np.abs(m), 8**-0.5)
    x = np.random.default_rng(0).standard_normal((20, 6))
    assert np.allclose(np.linalg.norm(nb.rotated(x, 1, 0), axis=1), np.linalg.norm(x, axis=1))
    codes = nb.codes(x, 3, 2)
    near = nb.probed(x, 3, 2, 7)
    assert (near[:, :, 0] == codes).all() and all(len(set(r)) == 7 for t in near for r in t)


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    width = len(rows[0][1])
    same = rows[7][1]
    rows += [(10_000 + 50 * i, same) for i in range(12)] + [(20_000, None), (20_050, []), (20_100, [0.0] * width),
             (20_150, [float("nan")] + [1.0] * (width - 1)), (20_200, [None] + [1.0] * (width - 1)), (None, same),
             (20_250, [float("inf")] + [1.0] * (width - 1)), (20_300, [1.0, 2.0, 3.0]), (20_301, [3.0, 2.0, 1.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"query": F.lit(1), "v": F.lit("x"), "table": F.lit(2)})


def test_recall_and_scores(vectors):
    rows, df = vectors
    got: dict[int, list] = {}
    for r in nb.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = exact(rows, 5, lambda i: i % 50 == 0)
    assert set(got) == {q for q, near in want.items() if near}
    hits = sum(len({i for i, _ in want[q]} & {i for _, i, _ in got[q]}) for q in got)
    assert hits >= 0.9 * sum(len(want[q]) for q in got)
    vectors_of = dict(rows)
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, len(want[q]) + 1))
        for _, i, s in near:
            x, y = np.array(vectors_of[q]), np.array(vectors_of[i])
            assert s == pytest.approx(float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)), abs=1e-12) and i != q
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
    # twelve copies, and the row they copy: the smallest other ids
    assert [i for _, i, _ in got[10_000]] == [7, 10_050, 10_100, 10_150, 10_200]
    assert got[20_300][0][1] == 20_301 and len(got[20_300]) == 1


def test_few_candidates_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    few = [(i, rng.standard_normal(16).tolist()) for i in range(4)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    got = nb.nearest(df, F.col("vec_id") >= 0).collect()
    want = exact(few, 5, lambda i: True)
    assert {q: sorted(r.vec_id for r in got if r.query_id == q) for q in want} == {q: sorted(i for i, _ in n) for q, n in want.items()}
    assert nb.nearest(df.limit(0), F.col("vec_id") >= 0).count() == 0
    monkeypatch.setattr(nb, "BLOCK", 7)  # blocks must not show in the result
    many = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    df = spark.createDataFrame(many, "vec_id long, embedding array<double>")
    small = {(r.query_id, r["rank"], r.vec_id) for r in nb.nearest(df, F.col("vec_id") % 5 == 0, probes=16).collect()}
    assert small == {(q, k + 1, i) for q, n in exact(many, 5, lambda i: i % 5 == 0).items() for k, (i, _) in enumerate(n)}


def test_exploded_queries_are_not_broadcast(spark):
    rows = lambda: spark.range(40).select(F.col("id"), F.array(F.col("id") % 7 + 1.0, F.col("id") % 3 - 1.0).alias("v")).withColumns(
        {"width": F.lit(2), "table": F.lit(0), "code": F.col("id") % 4})
    queries = rows().select("width", "table", "code", F.col("id").alias("query"), F.xxhash64("v").alias("mark"), "v")
    entries = rows().select("width", "table", "code", F.array("id").alias("ids"), "v")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nb._search(queries, entries, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(joins) == 2 and all("BuildRight" in line for line in joins)  # the buckets' sizes are on the right
