"""Streams that stop and start again, files of mixed headers, quoting, and metric divisions."""

import shutil

import pytest
from pyspark.sql import functions as F

from tallyline.operators import evaluate
from tallyline.operators.metrics import safe_division
from tallyline.sources import files
from tallyline.streaming import ingest


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("lost", [False, True])
def test_latest_row_survives_a_restart(spark, tmp_path, lost):
    schema, data, cp = "k string, t int, v string", tmp_path / "in", tmp_path / "cp"

    def run():
        stream = spark.readStream.schema(schema).parquet(str(data))
        return sorted(tuple(r) for r in ingest.latest_by_key(spark, stream, ["k"], ["t"], str(tmp_path / "s"), str(cp)).collect())

    put(spark, data, [("a", 1, "old"), ("b", 1, "only")], schema)
    assert run() == [("a", 1, "old"), ("b", 1, "only")]
    assert run() == [("a", 1, "old"), ("b", 1, "only")]
    put(spark, data, [("a", 2, "new")], schema)
    if lost:
        shutil.rmtree(cp)
    assert run() == [("a", 2, "new"), ("b", 1, "only")]


@pytest.mark.parametrize("lost", [False, True])
def test_shapes_survive_a_restart(spark, tmp_path, lost):
    schema, data, cp = "source string, arrival string, digest string", tmp_path / "in", tmp_path / "cp"

    def run():
        stream = spark.readStream.schema(schema).parquet(str(data))
        out = ingest.shape_changes(spark, stream, lambda b: b, str(tmp_path / "s"), str(cp))
        return sorted(tuple(r) for r in out.select("source", "arrival", "digest", "previous_digest").collect())

    put(spark, data, [("p", "1", "x")], schema)
    assert run() == [("p", "1", "x", None)]
    put(spark, data, [("p", "2", "y")], schema)
    if lost:
        shutil.rmtree(cp)
    assert run() == run() == [("p", "1", "x", None), ("p", "2", "y", "x")]


def test_files_are_known_by_content(spark, tmp_path):
    root, bronze = tmp_path / "in", str(tmp_path / "bronze")
    for folder, name, text in (("a", "one.csv", "h\n1\n2\n"), ("b", "one.csv", "h\n1\n2\n"), ("a", "two.csv", "h\n1\n2\n")):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / name).write_text(text)
    for run in range(3):  # the last two with a lost checkpoint
        ingest.ingest_extracts(spark, str(root), ["h"], bronze, str(tmp_path / f"cp{run}"))
    assert spark.read.parquet(bronze).count() == 4
    (root / "a" / "one.csv").write_text("h\n3\n")
    ingest.ingest_extracts(spark, str(root), ["h"], bronze, str(tmp_path / "cp9"))
    assert spark.read.parquet(bronze).count() == 5


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "plt01").mkdir()
    (tmp_path / "plt01" / "a.csv").write_text('x,y\n1,"say ""hi"", ok"\n,""\n')
    (tmp_path / "plt01" / "b.csv").write_text('y,x,"z"\n2,1,3\n')
    rows = files.read_extracts(spark, str(tmp_path)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("f"), "source_row",
                                                            "record").orderBy("f", "source_row").collect()
    assert [(r.f, r.source_row, r.record) for r in rows] == [
        ("a.csv", 1, {"x": "1", "y": 'say "hi", ok'}), ("a.csv", 2, {"x": "", "y": ""}),
        ("b.csv", 1, {"y": "2", "x": "1", "z": "3"})]
    (tmp_path / "plt01" / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    rows = files.read_extracts(spark, str(tmp_path)).where("source_row = 1").collect()
    assert {"x": "1", "y": "two\nlines"} in [r.record for r in rows]


@pytest.mark.parametrize("text, value", [("a / b", None), ("avg(a / b)", None), ("(a + 1) / (b + 2) / 2", 1.0),
                                         ("coalesce(a / (b / a), 7)", 7.0), ("sum(a) / sum(b)", None), ("a / 2 > 1", True),
                                         ("a / -b", None), ("a / - (2)", -1.5), ("a / 1e-3", 3000.0), ("a / .5e0 / 2", 3.0),
                                         ("a / `c d`", 0.75), ("concat('kg/lb', a / 2)", "kg/lb1.5"), ("a /* 1/0 */ / 4 -- x/0", 0.75),
                                         ("a / 4 -- of b / 0\n + 1", 1.75), ("a / case when b = 0 then 0 else 1 end", None),
                                         ("a / array(2, 0)[0]", 1.5), ("a / array(2, 0)[1]", None), ("a / named_struct('x', 2).x", 1.5),
                                         ("a / abs(b) + 1", None), ("'it''s 1/2' = 'it''s 1/2' and a / 2 = 1.5", True),
                                         ("a / 2 * 4", 6.0), ("2 * a / cast('4' as int)", 1.5)])
def test_divisions_at_any_depth(spark, text, value):
    df = spark.createDataFrame([(3, 0, 4)], "a int, b int, `c d` int")
    expr = F.expr(safe_division(text))
    assert (df.agg(expr) if "avg" in text or "sum" in text else df.select(expr)).first()[0] == value


def test_masters_keep_the_first_row_of_a_key(spark, tmp_path):
    (tmp_path / "c.csv").write_text("customer_no,customer_name\nC1,Zed\nC2,Bee\nC1,Abe\n")
    (tmp_path / "i.csv").write_text("item_no,item_name,uom,catch_weight_flag,avg_lb_per_case\nI1,z,lb,True,1.5\nI1,a,case,false,x\n")
    assert {tuple(r) for r in files.read_customers(spark, str(tmp_path / "c.csv")).collect()} == {("C1", "Zed"), ("C2", "Bee")}
    item = files.read_items(spark, str(tmp_path / "i.csv")).collect()
    assert [(r.item_name, r.uom, r.catch_weight_flag, r.avg_lb_per_case) for r in item] == [("z", "LB", True, 1.5)]


def test_questions_without_hits_are_counted(spark):
    hits = spark.createDataFrame([("q1", "bm25", "d1")], "query_id string, mode string, doc_id string")
    asked = spark.createDataFrame([("q1", "c", False), ("q2", "c", True)], "query_id string, challenge string, should_refuse boolean")
    labels = spark.createDataFrame([("d1", 1, 0)], "doc_id string, expected int, forbidden int")
    r = evaluate.retrieval_score(hits, asked, labels).first()
    assert (r.questions, r.doc_hits, r.forbidden_retrieved, r.exposures) == (2, 1, 0, 0)


def test_a_missing_contribution_is_not_within_tolerance(spark):
    found = spark.createDataFrame([("2024-01", True)], "period string, gap_flagged boolean")
    truth = spark.createDataFrame([("2024-01", 0.1)], "period string, true_gap double")
    r = evaluate.reconciliation_score(found, truth, F.lit(None).cast("double")).first()
    assert r.worst_error == float("inf") and not r.within_tolerance


def test_a_micro_batch_is_held_on_disk(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "one.csv").write_text("h\n1\n2\n")
    levels = lambda: {i.id(): i.storageLevel().useMemory() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
    known, held = levels(), []

    def look(step):
        held.extend(memory for rdd, memory in levels().items() if rdd not in known and step == "rows written")

    ingest.ingest_extracts(spark, str(tmp_path / "in"), None, str(tmp_path / "bronze"), str(tmp_path / "cp"), look)
    assert held and not all(held)  # the records; the list of files is small
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 2
