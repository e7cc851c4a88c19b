import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import mapping, metrics, policy, profile, retrieval, series
from tallyline.sources import files


def test_metric_expressions_are_limited(spark):
    bad = ["sum(otif)", "issue_date < date '2025-01-01'", "issue_date + interval '1' day", "rand() > 0.5", "exists(select 1)", "a.b.c(1)"]
    for text in bad:
        with pytest.raises(Exception):
            metrics.check_expression(spark, text, aggregate=False)
    with pytest.raises(metrics.MetricError):
        metrics.check_expression(spark, "sum(sum(x))", aggregate=True)
    with pytest.raises(metrics.MetricError):
        metrics.check_expression(spark, "x + 1", aggregate=True)
    for m in metrics.METRICS:
        metrics.check(spark, m)


def test_segmentation_and_names(spark):
    names = ["ORDERNUM", "UnitOfMeasure", "cfm_dlv_dt", "WT_ORD_KG", "PromiseDate", "weird"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.c for r in df.select("n", mapping.concepts("n").alias("c")).collect()}
    assert got["ORDERNUM"] == ["no", "order"]
    assert got["UnitOfMeasure"] == ["uom"]
    assert got["cfm_dlv_dt"] == ["confirmed", "date", "delivery"]
    assert got["WT_ORD_KG"] == ["order", "weight"]
    assert got["weird"] == ["weird"]


def test_dates_and_keys_map_on_every_header(spark, sf):
    """Columns whose evidence does not hang on this data's distinct shares must land where they belong."""
    from __spark_entry__ import queries

    got = {(r.source, r.source_col): (r.canonical_col, r.transforms)
           for r in queries()["m04_propose_mapping"](spark, sf).collect()}
    assert got[("plt01", "iss_dt")] == ("issue_date", "parse_date_iso")
    assert got[("plt02", "DT_CONFIRM")] == ("confirmed_delivery_date", "parse_date_us")
    assert got[("plt02", "WT_ORD_KG")] == ("ordered_weight_lb", "kg_to_lb")
    assert got[("plt03", "Line")][0] == "line_no" and got[("plt03", "Order")][0] == "order_no"


def test_drift_events_detected_and_named(spark, sf):
    from __spark_entry__ import queries

    rows = queries()["e02_drift_score"](spark, sf).collect()
    assert all(r.detected and r.named for r in rows) and len(rows) == 2


def test_exact_median_matches_numpy(spark):
    rng = random.Random(3)
    values = {"a": [rng.uniform(0.4, 0.5) for _ in range(501)], "b": [1.0] * 400 + [rng.uniform(0.01, 99) for _ in range(100)],
              "c": [2.0, 8.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r["median"] for r in profile.exact_median(df, ["k"], "v").collect()}
    for k, vs in values.items():
        assert got[k] == pytest.approx(float(np.median(vs)), abs=0)


def test_fuzzy_match_equals_close_matches(spark):
    rng = random.Random(5)
    keys = sorted({f"C{rng.randrange(10**6):06d}" for _ in range(300)})
    values = [k[:3] + rng.choice("0123456789Z") + k[4:] for k in keys[:60]] + [k[:4] + k[5:] for k in keys[60:100]]
    values = [v for v in set(values) if v not in keys and not policy_norm(v, keys)]
    got: dict[str, set] = {}
    out = policy.match_master(spark.createDataFrame([(v,) for v in values], "value string"),
                              spark.createDataFrame([(k,) for k in keys], "key string"), True)
    for r in out.collect():
        got.setdefault(r.value, set()).add(r.key)
    for v in values:
        assert got.get(v, set()) == set(difflib.get_close_matches(v, keys, n=3, cutoff=0.85)), v


def policy_norm(v, keys):
    d = v.removeprefix("C")
    return d.isdigit() and len(d.lstrip("0") or "0") <= 6 and f"C{int(d):06d}" in keys


def test_file_positions(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "x").mkdir()
        for name, n in (("a.csv", 500), ("b.csv", 7)):
            (tmp_path / "x" / name).write_text("id,v\n" + "".join(f"{i},\n" for i in range(1, n + 1)))
        out = files.number_rows(files.read_text(spark, str(tmp_path / "x")))
        assert out.rdd.getNumPartitions() > 0
        rows = files.to_records(out, ["id", "v"]).collect()
        assert len(rows) == 507
        assert all(int(r.record["id"]) == r.source_row and r.record["v"] == "" for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rank_fusion_arithmetic(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in retrieval.fuse({"a": a, "b": b}).collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["x"] == pytest.approx(1 / 61)


def test_chunks_keep_tables_and_headings(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | word word |" for i in range(12))
    body = f"intro\n\n# Title\n\n## One\ntext here\n\n{table}\n\n### Deep\nlast"
    df = spark.createDataFrame([("D1", "Doc", body)], "doc_id string, title string, body string")
    rows = retrieval.chunk_documents(df, budget=30).collect()
    assert [r.section for r in rows][0] == "" and rows[-1].section == "One > Deep"
    pieces = [r for r in rows if "| a | b |" in r.text]
    assert len(pieces) > 1 and all("|---|---|" in p.text for p in pieces)
    assert [r.chunk_id for r in rows] == [f"D1#{i}" for i in range(len(rows))]


def test_rows_without_an_id_are_split_by_themselves(spark):
    a, b = "# A\nfirst\n\n## One\nsecond", "third\n# B\nfourth"
    rows = [("D", "x", a), ("D", "x", b), ("D", "x", a), (None, "y", b), (None, "y", a), ("E", "z", None)]
    out = retrieval.chunk_documents(spark.createDataFrame(rows, "doc_id string, title string, body string")).collect()
    alone = {t: sorted((r.title, r.section, r.text) for r in retrieval.chunk_documents(spark.createDataFrame(
        [("D", "x", t)], "doc_id string, title string, body string")).collect()) for t in (a, b)}
    assert sorted((r.title, r.section, r.text) for r in out if r.doc_id == "D") == sorted(2 * alone[a] + alone[b])
    assert len([r for r in out if r.doc_id is None]) == len(alone[a]) + len(alone[b])
    ids = [r.chunk_id for r in out if r.doc_id == "D"]
    assert len(set(ids)) == len(ids)


def test_boilerplate_is_sequential(spark):
    rows = [("q", "t", 0.90, 1), ("q", "t", 0.88, 2), ("q", "t", 0.86, 3), ("q", "u", 0.88, 4)]
    df = spark.createDataFrame(rows, "query_id string, doc_type string, score double, rank int")
    assert sorted(r["rank"] for r in retrieval.drop_boilerplate(df).collect()) == [1, 3, 4]


def test_precedence_brings_in_the_other_side(spark):
    rows = [("q", f"c{i}", f"d{i}", "plain", i) for i in range(1, 7)] + [("q", "w", "W", "about WEIGHT", 7)]
    rows[1] = ("q", "c2", "L", "weight in kg", 2)
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id string, text string, rank int").withColumn(
        "status_note", F.lit(None).cast("string"))
    rules = spark.createDataFrame([(1, "W", "L", "t", ["weight"])], "rule_no int, winner string, loser string, topic string, terms array<string>")
    out = {r.chunk_id: " ".join(r.notes) for r in retrieval.precedence(df, df.where("rank <= 6"), rules).collect()}
    assert set(out) == {"c1", "c2", "c3", "c4", "c5", "w"}
    assert out["w"].startswith("TAKES PRECEDENCE") and out["c2"].startswith("OVERRIDDEN")


def test_backlog_counts_open_lines(spark):
    rows = [("p", "2025-01-01", "2025-01-03"), ("p", "2025-01-02", "2025-01-02"), ("p", "2025-01-02", "2025-01-05")]
    df = spark.createDataFrame(rows, "plant string, o string, i string").select(
        "plant", F.col("o").cast("date").alias("order_date"), F.col("i").cast("date").alias("metric_date"))
    got = {str(r.metric_date): r.open_backlog_lines for r in series.backlog(df).collect()}
    assert got == {"2025-01-02": 2, "2025-01-03": 1, "2025-01-05": 0}
