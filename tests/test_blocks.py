import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyline.operators import lexical as lx
from tallyline.operators import profile as pf
from tallyline.operators import publish as pb
from tallyline.operators import retrieval as rt


def test_best_of_each_row_equals_a_stable_sort():
    scores = np.round(np.random.default_rng(1).normal(size=(50, 300)), 1)
    scores[3, :] = 0.0
    scores[4, 5:] = -np.inf
    row, column = rt.best_columns(scores, 7)
    for i in range(50):
        order = np.argsort(-scores[i], kind="stable")[:7]
        assert sorted(column[row == i]) == sorted(j for j in order if np.isfinite(scores[i, j]))


def test_rights_are_judged_by_class_and_context():
    q = pd.DataFrame({"role": ["analyst", "leadership", "plant_user", "data_owner"], "asker_plant": [None, None, "P1", None],
                      "history": [False, True, False, True]})
    c = pd.DataFrame({"access_level": ["all", "restricted", "plant", "plant", "all"], "plant": [None, None, "P1", "P2", None],
                      "status": ["current", "current", "expired", "current", "superseded"]})
    assert rt._allowed(q, c).astype(int).tolist() == [[1, 0, 0, 0, 0], [1, 1, 1, 1, 1], [1, 0, 1, 0, 0], [1, 1, 0, 0, 1]]


def test_best_by_blocks_equals_the_full_list(spark, monkeypatch):
    for name in ("QUESTION_BLOCK", "CHUNK_BLOCK", "LIST_BLOCK"):
        monkeypatch.setattr(lx, name, 3)
    c = spark.range(40).selectExpr(
        "concat('c', lpad(id, 2, '0')) as chunk_id", "concat_ws(' ', concat('w', id % 3), concat('w', id % 5), 'same') as text",
        "if(id % 4 = 1, 'restricted', 'all') as access_level", "cast(null as string) as plant",
        "if(id % 6 = 2, 'superseded', 'current') as status")
    q = spark.range(8).selectExpr(
        "cast(id as string) as query_id", "concat_ws(' ', concat('w', id % 5), 'same') as query",
        "if(id % 2 = 0, 'analyst', 'leadership') as role", "cast(null as string) as asker_plant", "id % 3 = 0 as history")
    ix = lx.index(lx.counted(c), lambda name, df: df.persist())
    want = {(r.query_id, r.chunk_id, r["rank"]) for r in rt.top_k(rt.bm25(c, q), 4).collect()}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in rt.top_k(lx.bm25_best(ix, q, 4), 4).collect()} == want
    parts = c.select("chunk_id", "access_level", F.col("access_level").alias("part")).drop("access_level")
    by_part = {(r.query_id, r.chunk_id) for r in lx.bm25_best(ix, q, 2, parts).collect()}
    for part in ("all", "restricted"):
        mine = rt.bm25(c, q).join(parts.where(F.col("part") == part), "chunk_id")
        assert {(r.query_id, r.chunk_id) for r in rt.top_k(mine, 2).collect()} <= by_part


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_counted_without_a_sort(spark):
    bronze = spark.createDataFrame(
        [("b1", "s", "2", {"x": "a1", "y": " 5"}), ("b1", "s", "1", {"x": "b2", "y": "5"}), ("b0", "s", "9", {"x": "c", "y": ""})],
        "batch_id string, source string, source_row string, record map<string,string>")
    counts = pf.value_counts(pf.cells(bronze), ["source"])
    stats = pf.column_stats(counts, ["source"])
    assert "SortAggregate" not in plan(counts) and "SortAggregate" not in plan(stats)
    y = stats.where("column = 'y'").first()
    assert (y.rows, y.filled, y.distinct_pct, y.whitespace_pct) == (3, 2, 50.0, 50.0)
    shapes = {(r.column, r["shape"]): r.example for r in pf.top_shapes(counts, ["source"], cells_=pf.cells(bronze)).collect()}
    assert shapes[("x", "A9")] == "b2" and shapes[("x", "A")] == "c" and shapes[("y", " 9")] == " 5"


def test_column_statistics_fold_before_they_are_sent(spark):
    rows = [("b1", "s", str(i), {"x": f"k{i}", "y": t}) for i, t in enumerate(
        ["2020-01-31", " 2020-02-30", "1/2/2021", "13/2/2021", "-7", "7.00", "7.5", "", "+12-3-4", "-7 "])]
    bronze = spark.createDataFrame([*rows, ("b1", None, "99", {"x": "k"}), ("b2", None, "98", {"x": "k"})],
                                   "batch_id string, source string, source_row string, record map<string,string>")
    cells, by = pf.weighted_cells(pf.cells(bronze)), ["source", "batch_id"]
    folded = pf.column_stats(cells, by, distinct=False)
    keys = [line for line in plan(folded).splitlines() if "Exchange hashpartitioning" in line]
    assert len(keys) == 1 and "_text" not in keys[0] and "value" not in keys[0]  # a row per column and task, no values
    whole = pf.column_stats(cells, by)
    of_counts = pf.column_stats(pf.value_counts(pf.cells(bronze), by), by)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, of_counts.collect()))
    assert sorted(map(repr, whole.drop("distinct_pct").collect())) == sorted(map(repr, folded.collect()))
    y = whole.where("column = 'y'").first()
    assert (y.rows, y.filled, y.distinct_pct, y.whitespace_pct, y.dtype) == (10, 9, 88.889, 22.222, "string")
    assert [r.distinct_pct for r in whole.where("source is null").collect()] == [100.0, 100.0]
    days = spark.createDataFrame([("s", "d", t, 1) for t in ("1/2/2021", "13/2/2021", "31/2/2021")],
                                 "source string, column string, value string, n bigint")
    assert [(r.date_format, r.parsed_pct) for r in pf.column_stats(days, ["source"]).collect()] == [("dmy", 66.667)]


def test_first_value_of_a_shape_with_a_row_without_batch(spark):
    bronze = spark.createDataFrame([("b1", "s", "1", {"x": "a1"}), (None, "s", "2", {"x": "c3"}), ("b0", "s", "9", {"x": "b2"})],
                                   "batch_id string, source string, source_row string, record map<string,string>")
    cells = pf.cells(bronze)
    assert pf.top_shapes(pf.value_counts(cells, ["source"]), ["source"], cells_=cells).first().example == "c3"


def test_lines_are_judged_once_for_fact_and_held(spark):
    blank = ", ".join(f"cast(null as string) as {c}" for c in ("customer_no", "item_no", "lot_no"))
    silver = spark.range(6).selectExpr(
        "concat('b', id % 2) as batch_id", "if(id % 2 = 0, 's', 't') as source", "cast(id as string) as source_row", "concat('o', id % 3) as order_no",
        "1 as line_no", blank.split(", ")[2], *[f"'x' as {c}" for c in pb.REQUIRED if c not in ("order_no", "line_no")])
    queue = spark.createDataFrame([], "batch_id string, source_row string, resolution_kind string, status string, severity string")
    batches = spark.createDataFrame([("b0", "s", "h", "validated", False, "2"), ("b1", "t", "h", "validated", False, "1")],
                                    "batch_id string, source string, header_hash string, status string, stale boolean, received_at string")
    alerts = spark.createDataFrame([], "alert_id int, source string, shape string, status string")
    items = spark.createDataFrame([("x", "g", True)], "item_no string, product_group string, catch_weight_flag boolean")
    lots = spark.createDataFrame([], "lot_no string, production_date date, expiry_date date")
    kept = []

    def store(df):
        kept.append(df)
        return df.localCheckpoint()

    gold, held = pb.publish_all(silver, queue, batches, alerts, items, lots, store)
    assert len(kept) == 1
    assert {(r.order_no, r.batch_id) for r in gold.collect()} == {("o0", "b0"), ("o1", "b0"), ("o2", "b0")}
    assert [(r.batch_id, r.held) for r in held.collect()] == [("b1", pb.HELD[4])] * 3
