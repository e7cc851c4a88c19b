"""Blocks of two tables meet without copies; what the block kernels pick equals plain ones."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyline.operators import blocks
from tallyline.operators import lexical as lx
from tallyline.operators import retrieval as rt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_pair_meets_once(spark):
    def pairs(a, b):
        x, y = a["id"].to_numpy(), b["id"].to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, len(y))), pa.array(np.tile(y, len(x)))], ["a", "b"])

    left = blocks.packed(spark.range(50), F.col("id"), 4, lambda t: [t], ["_l"])
    right = blocks.packed(spark.range(30), F.col("id"), 7, lambda t: [t], ["_r"])
    met = blocks.crossed(left, right, (4, 7), pairs, "a bigint, b bigint")
    assert met.rdd.getNumPartitions() == 28
    assert sorted(tuple(r) for r in met.collect()) == [(a, b) for a in range(50) for b in range(30)]
    none = blocks.packed(spark.range(0), F.col("id"), 1, lambda t: [t], ["_r"])
    assert blocks.crossed(left, none, (4, 1), pairs, "a bigint, b bigint").count() == 0
    assert (blocks.number(0, 5), blocks.number(5, 5), blocks.number(6, 5)) == (1, 1, 2)


def corpus(spark):
    c = spark.range(60).selectExpr(
        "if(id = 7, null, concat('c', lpad(id % 50, 2, '0'))) as chunk_id", "concat_ws(' ', concat('w', id % 3), concat('w', id % 5), "
        "repeat(' same', cast(1 + id % 4 as int))) as text", "if(id % 4 = 1, 'restricted', 'all') as access_level",
        "cast(null as string) as plant", "if(id % 6 = 2, 'superseded', 'current') as status")
    q = spark.range(9).selectExpr(
        "cast(id as string) as query_id", "concat_ws(' ', concat('w', id % 5), 'same', 'nowhere') as query",
        "if(id % 2 = 0, 'analyst', 'leadership') as role", "cast(null as string) as asker_plant", "id % 3 = 0 as history")
    return c, q


def test_postings_are_not_copied_for_blocks_of_questions(spark, monkeypatch):
    """c01 to c09 occur twice, with other lengths and classes; one chunk has no id."""
    c, q = corpus(spark)
    ix = lx.index(lx.counted(c), lambda name, df: df.persist())
    whole = {(r.query_id, r.chunk_id): r.score for r in lx.bm25(ix, q).collect()}
    monkeypatch.setattr(lx, "QUESTION_BLOCK", 2)
    monkeypatch.setattr(lx, "CHUNK_BLOCK", 7)
    best = lx.bm25_best(ix, q, 4)
    assert "CartesianProduct" in plan(best) and "explode(sequence" not in plan(best)
    parted = {(r.query_id, r.chunk_id): r.score for r in lx.bm25(ix, q).collect()}
    assert whole.keys() == parted.keys() and all(abs(whole[k] - parted[k]) < 1e-9 for k in whole)
    want = {}
    for (query, chunk), score in whole.items():
        want.setdefault(query, []).append((-round(score, 9), chunk is not None, chunk or "", chunk))
    got = rt.top_k(best, 4).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(x, h[3]) for x, hits in want.items() for h in sorted(hits)[:4]}


def test_picked_scores_are_those_of_the_rounded_list():
    scores = np.array([0.0, 0.3, 0.3 + 4e-10, 0.3 - 4e-10, 0.1, 3e-10, 0.0])
    for k in (1, 2, 3, 4, 9):
        at, found = lx._pick(scores, k)
        rounded = np.round(scores, 9)
        want = [i for i in np.argsort(-rounded, kind="stable")[:k] if rounded[i] > 0]
        assert sorted(at) == sorted(want) and found.tolist() == rounded[at].tolist()
    assert lx._pick(scores, None)[0].tolist() == [1, 2, 3, 4, 5]


def test_nearest_columns_equal_a_stable_sort():
    rng = np.random.default_rng(4)
    for n, k in ((300, 7), (5000, 3), (5, 9)):
        sims = np.round(rng.normal(size=(20, n)), 2) + rng.normal(size=(20, n)) * 1e-12
        sims[3, n // 2:] = -np.inf
        row, column, score = rt._nearest(sims, k)
        for i in range(20):
            rounded = np.round(sims[i], 9)
            want = np.argsort(-rounded, kind="stable")[:k]
            assert column[row == i].tolist() == want.tolist() and score[row == i].tolist() == rounded[want].tolist()


def test_vectors_are_not_copied_for_blocks_of_questions(spark, monkeypatch):
    c, q = corpus(spark)
    vec = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: ((F.xxhash64("text") + i * 77) % 5).cast("double"))
    c, q = c.withColumn("vector", vec), q.withColumn("text", F.col("query")).withColumn("vector", vec).drop("text")
    want = {(r.query_id, r.chunk_id, r.score) for r in rt.vector_topk(c, q, 5).collect()}
    pairs = spark.createDataFrame(sorted({w[:2] for w in want if w[1]}), "query_id string, chunk_id string")
    ranks = {tuple(r) for r in rt.vector_ranks(c, q, pairs).collect()}
    for name, size in (("QUESTION_BLOCK", 2), ("CHUNK_BLOCK", 7), ("STRIP", 2)):
        monkeypatch.setattr(rt, name, size)
    best = rt.vector_topk(c, q, 5)
    assert "CartesianProduct" in plan(best) and "explode(sequence" not in plan(best)
    got = {(r.query_id, r.chunk_id, r.score) for r in best.collect()}
    assert sorted((g[0], g[2]) for g in got) == sorted((w[0], w[2]) for w in want)
    assert ranks == {tuple(r) for r in rt.vector_ranks(c, q, pairs).collect()}


def test_hashing_vectors_send_no_words(spark):
    texts = spark.createDataFrame([("a", "x y x"), ("b", "z"), ("c", ""), ("d", None)], "k string, t string")
    v = rt.hashing_vectors(texts, "k", "t")
    exchanged = [line for line in plan(v).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any(" w#" in line or "(w#" in line for line in exchanged)
    got = {r.k: r.vector for r in v.collect()}
    assert got.keys() == {"a", "b"} and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values())


def test_fused_ranks_need_no_full_list(spark, monkeypatch):
    c, q = corpus(spark)
    c = c.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    ix = lx.prepared(lx.index(lx.counted(c), lambda name, df: df.persist()), q)
    monkeypatch.setattr(lx, "QUESTION_BLOCK", 4)
    full = {(r.query_id, r.chunk_id): r["rank"] for r in rt.ranked(lx.bm25(ix, q)).collect()}
    pairs = q.select("query_id").crossJoin(c.select("chunk_id"))
    assert {(r.query_id, r.chunk_id): r["rank"] for r in lx.bm25_ranks(ix, q, pairs).collect()} == full


def test_pruned_top_k_from_few_seeds_equals_the_full_list(spark, sf, monkeypatch):
    from tallyline.plans import search

    c, q = search.chunks(spark, sf), search.questions(spark, sf)
    names = []
    keep = lambda name, df: names.append(name) or df.persist()
    ix = lx.index(lx.counted(c), keep)
    want = {(r.query_id, r.chunk_id, r["rank"]): r.score for r in rt.top_k(lx.bm25(ix, q), 4).collect()}
    for name, size in (("SEED", 2), ("CHUNK_BLOCK", 70), ("QUESTION_BLOCK", 20)):
        monkeypatch.setattr(lx, name, size)
    best = lx.bm25_top(ix, q, 4, keep)
    assert "CartesianProduct" in plan(best) and "lexical_forward" not in names  # no chunk's terms travel with its questions
    got = {(r.query_id, r.chunk_id, r["rank"]): r.score for r in best.collect()}
    assert got.keys() == want.keys() and all(abs(got[key] - want[key]) < 2e-9 for key in want)


def test_full_lists_are_scored_once(spark):
    rows = [("q1", "c2", 0.5), ("q1", "c1", 0.5), ("q1", "c3", 2.25), ("q2", "c1", 1e-12), (None, "c1", 1.0)]
    listed = rt.ranked(spark.createDataFrame(rows, "query_id string, chunk_id string, score double"))
    assert "Join" not in plan(listed) and plan(listed).count("Scan") == 1
    assert {tuple(r) for r in listed.collect()} == {("q1", "c3", 2.25, 1), ("q1", "c1", 0.5, 2), ("q1", "c2", 0.5, 3), ("q2", "c1", 0.0, 1)}
