"""Linked vectors against brute force, hot families, balls, and the traversal against a heap."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import multi_index as mi


def plain(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) of every row by all pairs."""
    fit = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v
           and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for at, p in enumerate(fit):
        x = np.array(rows[p][1], float)
        x = x / np.abs(x).max()
        for q in fit[:at]:
            if rows[p][2] == rows[q][2] and len(rows[p][1]) == len(rows[q][1]):
                y = np.array(rows[q][1], float)
                y = y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[p].add(q)
                    links[q].add(p)
    low = {}
    for k in range(len(rows)):
        if k not in low:
            seen, todo = {k}, [k]
            while todo:
                for q in links[todo.pop()] - seen:
                    seen.add(q)
                    todo.append(q)
            top = min((rows[q][0] for q in seen if rows[q][0] is not None), default=None)
            low.update(dict.fromkeys(seen, top))
    return sorted((-1 if i is None else i, len(links[k]), -1 if low[k] is None else low[k], low[k] is None or i == low[k])
                  for k, (i, _, _) in enumerate(rows))


def mine(df, **options):
    return sorted(tuple(-1 if x is None else x for x in r) for r in mi.near_duplicates(df, **options).collect())


def families(rng, width, sizes, spread):
    for n, s in zip(sizes, spread, strict=True):
        base = rng.standard_normal(width)
        base /= np.linalg.norm(base)
        for _ in range(n):
            yield (base + s * rng.standard_normal(width) / math.sqrt(width)).tolist()


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_brute_force(spark, sf, monkeypatch, block):
    monkeypatch.setattr(mi, "BLOCK", block)
    monkeypatch.setattr(mi, "CELL", 8)
    rng = np.random.default_rng(block)
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(200).collect()]
    width = len(rows[0][1])
    made = families(rng, width, [120, 40, 40, 60, 2, 2], [0.05, 0.2, 0.27, 0.35, 0.1, 0.25])
    rows += [(1000 + 3 * k, v, 1 + k % 2 * (k > 180)) for k, v in enumerate(made)]
    same = rows[7]
    rows += [(5000 - i, same[1], same[2]) for i in range(60)] + [(6000, same[1], same[2] + 1), (6001, same[1], None)]
    rows += [(7000, None, 1), (7001, [], 1), (7002, [0.0] * width, 1), (7003, [-0.0] * width, 1), (7006, [None] * width, 1),
             (7004, [float("nan")] + [1.0] * (width - 1), 1), (7005, [float("inf")] * width, 1), (None, same[1], same[2]),
             (7010, [1.0, 2.0], 1), (7011, [2.0, 4.0], 1), (7012, [2.0], 1), (7013, [1e200], 1), (7014, [-3.0], 1),
             (7020, [x * 1e-200 for x in same[1]], same[2]), (7021, [x * 1e180 for x in same[1]], same[2]),
             (1003, rows[20][1], rows[20][2]), (7022, [0.0 if x == min(same[1]) else x for x in same[1]], same[2]),
             (7023, [-0.0 if x == min(same[1]) else x for x in same[1]], same[2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {"n": F.lit("x"), "cell": F.lit(1), "v": F.lit(2), "mark": F.lit(None)}).repartition(6)
    want = plain(rows)
    assert mine(df, recall=1.0) == want  # the traversal goes as far as any linked pair can be
    got, links = mine(df), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.99 * links


def test_empty_and_single(spark):
    df = spark.createDataFrame([(4, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    assert mine(df) == [(4, 0, 4, True)] and mine(df.limit(0)) == []


def test_a_family_goes_on_as_few_balls():
    import pyarrow as pa
    v = list(families(np.random.default_rng(2), 32, [300, 50], [0.1, 0.1]))
    n = len(v)
    table = pa.table({"id": range(n), "n": [1] * n, "label": ["x"] * n, "width": pa.array([32] * n, pa.int32()),
                      "cell": pa.array([0] * n, pa.int32()), "block": pa.array([0] * n, pa.int32()), "v": v})
    out = mi._balls(0.93)(table)
    assert len(out.filter(pa.compute.is_valid(out["v"]))) == 2 and sorted(set(out["links"].to_pylist())) == [49, 299]


def test_traversal_pops_pairs_in_order():
    rng = np.random.default_rng(4)
    index = mi.MultiIndex(rng.standard_normal((500, 10)), 12, 0.9)
    x = mi._units(rng.standard_normal((40, 10)))
    _, (p, q) = index._cells(x)
    for r, got in enumerate(index.visits(x, np.zeros(40))):
        a, b = sorted((h**2, i) for i, h in enumerate(p[r])), sorted((h**2, i) for i, h in enumerate(q[r]))
        heap, seen, want = [(a[0][0] + b[0][0], 0, 0)], {(0, 0)}, []
        while heap and heap[0][0] <= index.stop:
            _, i, j = heapq.heappop(heap)
            want.append(a[i][1] * 12 + b[j][1])
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < 12 and j2 < 12 and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (a[i2][0] + b[j2][0], i2, j2))
        assert sorted(got.tolist()) == sorted(want) and got[0] == want[0]


def test_recall_at_the_threshold_and_the_exact_stop():
    rng = np.random.default_rng(6)
    x = mi._units(rng.standard_normal((3000, 64)))
    y = rng.standard_normal(x.shape)
    y = mi._units(y - (y * x).sum(1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    for recall in (0.999, 1.0):
        index = mi.MultiIndex(rng.standard_normal((4000, 64)), 16, 0.93, recall)
        at_x, at_y = index.cells(x), index.cells(y)
        zero = np.zeros(len(x))
        met = [b in set(v.tolist()) or a in set(w.tolist()) for a, b, v, w in zip(
            at_x, at_y, index.visits(x, zero), index.visits(y, zero), strict=True)]
        assert np.mean(met) >= (0.995 if recall < 1 else 1.0)
