"""The extract data source: layout, headers, quoting, failures, digests, streams, the writer; and keyed segments."""

import csv
import hashlib
import io
import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyline.sources import extract_source as es
from tallyline.sources import files
from tallyline.streaming import ingest
from tallyline.streaming.segments import Segments


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def roots(tmp_path):
    """Three plants' files: other headers, quoted commas and line breaks, a byte order mark, and files that cannot be read."""
    up, src = tmp_path / "uploads", tmp_path / "sources"
    put(src, "plt01/plt-01_orderlines_2026-01.csv", 'ord_no,ln,"cust, no"\nA1,1,"say ""hi"", ok"\nA2,2,"two\r\nlines"\n\nA3\n')
    put(src, "plt01/plt-01_orderlines_2026-02.csv", "﻿ln,ord_no,lot_no\n1,B1,\n")
    put(src, "plt02/plt-02_orderlines_2026-01.csv", "ORDERNUM,ORDERLINE,ORDERLINE\nX,1,2\n")
    put(src, "plt02/long.csv", "a,b\n1,2\n3,4,5\n6,7\n")
    put(src, "plt02/bytes.csv", b"a,b\n1,2\n\xff\xfe,3\n")
    put(src, "plt02/empty.csv", "")
    put(src, "plt02/notes.txt", "no extract")
    put(src, "_hidden/x.csv", "a\n1\n")
    os.symlink(src / "gone", src / "plt02" / "link.csv")
    put(up, "plt01/plt-01_orderlines_2026-02.csv", "ln\n7\n")
    put(up, "plt03/only-here.csv", "h\nv\n")
    return [str(up), str(src), str(tmp_path / "none")]


def test_listing_headers_and_failures(spark, roots):
    found = {(r.source, r.file_name): r for r in es.read(spark, roots, "batches").collect()}
    assert {k for k, r in found.items() if r.error is None} == {
        ("plt01", "plt-01_orderlines_2026-01.csv"), ("plt01", "plt-01_orderlines_2026-02.csv"), ("plt03", "only-here.csv"),
        ("plt02", "plt-02_orderlines_2026-01.csv")}
    assert found["plt01", "plt-01_orderlines_2026-01.csv"].header == ["ord_no", "ln", "cust, no"]
    assert found["plt02", "plt-02_orderlines_2026-01.csv"].header == ["ORDERNUM", "ORDERLINE", "ORDERLINE.1"]
    assert found["plt01", "plt-01_orderlines_2026-02.csv"].path.startswith(roots[0])  # the first root's
    for name, why in (("long.csv", "line 3: 3 fields"), ("bytes.csv", "utf-8"), ("empty.csv", "no header")):
        assert why in found["plt02", name].error and found["plt02", name].error.startswith(f"cannot read plt02/{name}: ")
    assert not any(k[0].startswith("_") or k[1].endswith(".txt") for k in found)
    log = {r.file_name: r for r in files.batch_log(spark, roots).where("source = 'plt02'").collect()}
    assert (log["long.csv"].status, log["long.csv"].row_count) == ("failed", 0)
    assert log["plt-02_orderlines_2026-01.csv"].status == "received"


def test_rows_keep_text_and_order(spark, roots):
    rows = es.read(spark, roots[1]).collect()
    bad = {r.file_name for r in rows if r.error is not None}
    assert {"long.csv", "bytes.csv", "empty.csv"} <= bad and all(r.record is None for r in rows if r.error is not None)
    assert not bad & {r.file_name for r in rows if r.record is not None}  # no row of a file that fails later on
    got = {(r.file_name, r.source_row): r.record for r in rows if r.record is not None}
    assert got["plt-01_orderlines_2026-01.csv", 1] == {"ord_no": "A1", "ln": "1", "cust, no": 'say "hi", ok'}
    assert got["plt-01_orderlines_2026-01.csv", 2]["cust, no"] == "two\r\nlines"
    assert got["plt-01_orderlines_2026-01.csv", 3] == {"ord_no": "A3", "ln": "", "cust, no": ""}
    order = es.read(spark, roots[1]).where("file_name = 'plt-01_orderlines_2026-02.csv'").select(F.map_keys("record")).first()[0]
    assert order == ["ln", "ord_no", "lot_no"]


def test_rows_equal_a_plain_reader_on_random_tables(spark, tmp_path):
    rng, want = random.Random(3), {}
    for n in range(12):
        header = [f"c{i}" for i in range(rng.randrange(1, 6))]
        body = [["".join(rng.choice('ab,"\n\r é') for _ in range(rng.randrange(6))) or "x" for _ in header]
                for _ in range(rng.choice([0, 3, 50, 9000 if n == 5 else 7]))]
        out = io.StringIO(newline="")
        csv.writer(out).writerows([header, *body])
        put(tmp_path, f"s{n % 3}/f{n}.csv", out.getvalue())
        want |= {(f"f{n}.csv", i + 1): dict(zip(header, r, strict=True)) for i, r in enumerate(body)}
    got = {(r.file_name, r.source_row): r.record for r in es.read(spark, str(tmp_path)).collect()}
    assert got == want
    assert es.read(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("leaves_per_task", [1, 3, 50])
def test_tree_digest_whatever_the_splits(spark, tmp_path, monkeypatch, leaves_per_task):
    rng = random.Random(1)
    sizes = [0, 1, es.LEAF - 1, es.LEAF, es.LEAF + 1, 5 * es.LEAF + 77]
    for n, size in enumerate(sizes):
        put(tmp_path, f"s/f{n}.csv", rng.randbytes(size))
    one = {r.file_name: r.digest for r in es.read(spark, str(tmp_path), "batches").collect()}
    many = es.tree_digest(es.read(spark, str(tmp_path), "leaves", leaves_per_task=leaves_per_task))
    assert {r.file_name: r.digest for r in many.collect()} == one
    for n in range(4):  # a file of one leaf has its plain digest
        assert one[f"f{n}.csv"] == hashlib.sha256((tmp_path / f"s/f{n}.csv").read_bytes()).hexdigest()
    # several levels: the fold over rows equals the fold over a list
    leaves = [hashlib.sha256(bytes([i])).hexdigest() for i in range(70)]
    monkeypatch.setattr(es, "FAN", 4)
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate(leaves)] + [("b", 0, leaves[3])], "k string, leaf long, digest string")
    assert {r.k: r.digest for r in es.tree_digest(df.repartition(7), ["k"]).collect()} == {
        "a": es.root_of([bytes.fromhex(x) for x in leaves]), "b": leaves[3]}


def test_writer_round_trip(spark, tmp_path):
    rows = [(f"p{i % 2}", f"f{i % 3}.csv", ["a", "b,c"], [str(i), f'x"{i}\n']) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, file_name string, header array<string>, values array<string>")
    es.write(df.repartition("source", "file_name"), str(tmp_path / "out"))
    got = es.read(spark, str(tmp_path / "out")).collect()
    assert sorted((r.source, r.file_name, r.record["a"], r.record["b,c"]) for r in got) == sorted(
        (s, f, v[0], v[1]) for s, f, _, v in rows)


def ingested(spark, bronze):
    return sorted((r.source, r.file_name, r.source_row) for r in spark.read.parquet(bronze).collect())


@pytest.mark.parametrize("step", ["rows written", "log written"])
def test_a_run_killed_between_steps_goes_on(spark, tmp_path, step):
    root, bronze, cp = tmp_path / "in", str(tmp_path / "bronze"), str(tmp_path / "cp")
    put(root, "a/one.csv", "h\n1\n2\n")
    put(root, "b/two.csv", "g,h\n1,2\n")
    put(root, "b/bad.csv", "g\n1,2\n")

    def killed(at):
        if at == step:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        ingest.ingest_extracts(spark, str(root), None, bronze, cp, killed)
    assert ingested(spark, bronze) == []
    want = [("a", "one.csv", 1), ("a", "one.csv", 2), ("b", "two.csv", 1)]
    for place in (cp, cp, str(tmp_path / "lost")):
        ingest.ingest_extracts(spark, str(root), None, bronze, place)
        assert ingested(spark, bronze) == want
    log = {r.file_name: (r.status, r.row_count) for r in ingest.batch_log(spark, bronze).collect()}
    assert log == {"one.csv": ("received", 2), "two.csv": ("received", 1), "bad.csv": ("failed", 0)}
    assert ingest.batch_log(spark, bronze).count() == 3


def test_a_stream_reads_new_files_only(spark, tmp_path):
    root, bronze, cp = tmp_path / "in", str(tmp_path / "bronze"), str(tmp_path / "cp")
    for n in range(3):
        put(root, f"a/f{n}.csv", f"h{n}\n{n}\n")
        ingest.ingest_extracts(spark, str(root), None, bronze, cp)
        entries = sorted(p for p in os.listdir(f"{cp}/files") if p.endswith(".json"))
        assert [len(json.load(open(f"{cp}/files/{e}"))) for e in entries] == [1] * (n + 1)
    assert ingested(spark, bronze) == [("a", f"f{n}.csv", 1) for n in range(3)]


def test_segments_write_what_they_are_given(spark, tmp_path):
    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "s") if "log" not in d for f in fs)

    table = Segments(spark, str(tmp_path / "s"), "k long, t int, v string", ["k"], ["t"], fan=4)
    table.append(spark.range(60_000).select(F.col("id").alias("k"), F.lit(0).alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    whole, grown, want = size(), [], {}
    for n in range(1, 8):
        before = size()
        rows = [(n, n, f"new{n}"), (n + 1, n, f"new{n}"), (3, -n, "late")]
        table.append(spark.createDataFrame(rows, "k long, t int, v string"))
        grown.append(size() - before)
        for k, t, v in rows:
            if t >= want.get(k, (0, ""))[0]:
                want[k] = (t, v)
    assert sum(g > whole / 10 for g in grown) == 1  # one fold in seven appends wrote the first segment once more
    assert len(table.live()) <= 2 * 3
    got = {r.k: (r.t, r.v) for r in table.read().where("k < 12").collect()}
    assert {k: got[k] for k in want} == want and table.read().count() == 60_000
    few = table.of_keys(spark.createDataFrame([(5,), (99,)], "k long"), ["k"]).collect()
    assert {r.k: r.t for r in few} == {5: 5, 99: 0}
