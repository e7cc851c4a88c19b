from datetime import date

import pytest

from pyspark.sql import functions as F

from tallyline.operators import exceptions as ex
from tallyline.operators import ingest, policy, rules
from tallyline.schema import COLUMNS, Dated, FieldDictionary, lot_dictionary

GOOD = dict(order_no="SO1", line_no=1, customer_no="C000001", item_no="IT1", plant="PLT-01",
            order_date=date(2026, 1, 1), requested_date=date(2026, 1, 8), confirmed_delivery_date=date(2026, 1, 8),
            issue_date=date(2026, 1, 8), ordered_qty=10.0, invoiced_qty=10.0, ordered_weight_lb=100.0,
            invoiced_weight_lb=100.0, uom="CASE", lot_no="L2")
SCHEMA = ("batch_id string, source string, source_row int, order_no string, line_no int, customer_no string, item_no "
          "string, plant string, order_date date, requested_date date, confirmed_delivery_date date, issue_date date, "
          "ordered_qty double, invoiced_qty double, ordered_weight_lb double, invoiced_weight_lb double, uom string, "
          "lot_no string, parse_errors map<string,string>, mapped array<string>")


def lines(spark, changes, mapped=None):
    rows = []
    for i, change in enumerate(changes, start=1):
        r = {**GOOD, "order_no": f"SO{i}", **change}
        rows.append(("b1", "plt01", i, *[r[c] for c in COLUMNS], r.get("parse_errors", {}), mapped or COLUMNS))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def masters(spark):
    return rules.Masters(
        spark.createDataFrame([("C000001",)], "customer_no string"),
        spark.createDataFrame([("IT1", "case", 10.0)], "item_no string, uom string, avg_lb_per_case double"),
        spark.createDataFrame([("L1", date(2026, 1, 2)), ("L2", date(2026, 3, 1))], "lot_no string, expiry_date date"))


CASES = [
    ("V001", {"customer_no": None}, "Required field(s) blank: ['customer_no']"),
    ("V002", {"issue_date": date(2025, 12, 1)}, None),
    ("V002", {"confirmed_delivery_date": date(2025, 11, 1)}, None),
    ("V003", {"invoiced_weight_lb": 106.0}, None),
    ("V003", {"invoiced_weight_lb": -1.0}, None),
    ("V004", {"customer_no": "C999999"}, "Customer C999999 is not in the customer master"),
    ("V005", {"item_no": "ZZ"}, "Item ZZ is not in the item master"),
    ("V006", {"lot_no": "L1"}, "Lot L1: shipped after expiry"),
    ("V006", {"lot_no": "XX"}, "Lot XX: lot not in the lot master"),
    ("V007", {"invoiced_qty": -1.0}, None),
    ("V009", {"uom": "kg", "ordered_weight_lb": 45.36, "invoiced_weight_lb": 45.0},
     "UOM kg differs from item master basis CASE"),
    ("V010", {"issue_date": None, "parse_errors": {"issue_date": "31/31/2020"}},
     "Value(s) did not parse: {'issue_date': '31/31/2020'}"),
    ("V011", {"ordered_qty": 0.0}, None),
]


@pytest.mark.parametrize("rule,change,reason", CASES)
def test_one_violation_each(spark, masters, rule, change, reason):
    found = rules.violations(lines(spark, [{}, change]), masters, FieldDictionary()).collect()
    hit = [f for f in found if f.rule_id == rule]
    assert [f.source_row for f in hit] == [2]
    assert {f.source_row for f in found} == {2}
    if reason:
        assert hit[0].reason == reason


def test_nulls_pass_comparisons(spark, masters):
    quiet = [{"ordered_weight_lb": None}, {"invoiced_weight_lb": None}, {"invoiced_qty": None}, {"uom": None}]
    assert rules.violations(lines(spark, quiet), masters, FieldDictionary()).count() == 0


def test_repeat_keeps_first(spark, masters):
    found = rules.violations(lines(spark, [{"order_no": "A"}, {"order_no": "A"}, {"order_no": "A"}]), masters,
                             FieldDictionary(), ["V008"]).collect()
    assert sorted((f.source_row, f.details["first_row"]) for f in found) == [(2, "1"), (3, "1")]


def test_dated_requirement(spark, masters):
    d = lot_dictionary(date(2026, 2, 1))
    rows = [{"lot_no": None, "issue_date": date(2026, 1, 31)}, {"lot_no": None, "issue_date": date(2026, 2, 1)},
            {"lot_no": None, "issue_date": None}]
    found = {f.source_row: f for f in rules.violations(lines(spark, rows), masters, d, ["V012"]).collect()}
    assert {k: v.severity for k, v in found.items()} == {1: "warn", 2: "block"}
    assert found[2].owner == "quality"
    no_lot = [c for c in COLUMNS if c != "lot_no"]
    absent = rules.violations(lines(spark, rows[1:2], no_lot), masters, d, ["V006", "V012"]).collect()
    assert [(f.rule_id, f.reason) for f in absent] == [(
        "V012", "lot_no required from 2026-02-01 (field dictionary v2) is not in this source's extract")]


def test_block_beats_warning_and_later_warning_wins(spark, masters):
    late = Dated("lot_no", date(2027, 1, 1), "issue_date", "quality", "f", "later warning")
    early = Dated("uom", date(2025, 1, 1), "issue_date", "plant", "f2", "b2")
    row = [{"lot_no": None, "uom": None}]
    both = rules.violations(lines(spark, row), masters, FieldDictionary(2, dated=[late, early]), ["V012"]).collect()
    assert [(f.severity, f.owner) for f in both] == [("block", "plant")]
    other = Dated("uom", date(2028, 1, 1), "issue_date", "plant", "f2", "second")
    warn = rules.violations(lines(spark, row), masters, FieldDictionary(2, dated=[late, other]), ["V012"]).collect()
    assert [f.suggested_fix for f in warn] == ["second"]


def test_rules_read_lines_once(spark, masters):
    df = rules.violations(lines(spark, [{}]), masters, FieldDictionary())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Window" not in plan


def test_sync_and_fold(spark, masters):
    first = rules.violations(lines(spark, [{"customer_no": "C9"}, {"item_no": "ZZ"}]), masters, FieldDictionary())
    queue = first.drop("details").selectExpr("*", "'open' as status", "cast(null as string) as resolution_kind",
                                             "cast(null as string) as resolved_by")
    again = rules.violations(lines(spark, [{"customer_no": "C9"}, {}]), masters, FieldDictionary())
    state = {r.rule_id: (r.status, r.change) for r in ex.sync(queue, again).collect()}
    assert state == {"V004": ("open", "kept"), "V005": ("resolved", "auto_resolved")}
    q = queue.withColumn("exception_id", ex.exception_id())
    ids = {r.rule_id: r.exception_id for r in q.collect()}
    events = spark.createDataFrame(
        [(ids["V004"], 1, "assigned", "u", "team", None, None), (ids["V004"], 2, "resolved", "o", None, "accept", "short"),
         (ids["V004"], 3, "resolved", "o", None, "accept", "checked with plant"),
         (ids["V004"], 4, "assigned", "u", "late", None, None)],
        "exception_id string, event_id int, action string, actor string, owner string, kind string, reason string")
    folded, refused = ex.fold(q, events)
    row = folded.where("rule_id = 'V004'").first()
    assert (row.status, row.owner, row.resolution_kind) == ("resolved", "team", "accept")
    assert {r.event_id: r.refused for r in refused.collect()} == {2: "invalid resolution", 4: "already resolved"}


def below_joins(df):
    """The plan from its first join downwards: what is worked out there travels through the exchanges."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Join"):]


def test_only_the_columns_a_rule_asks_for_travel(spark, masters):
    found = rules.violations(lines(spark, [{"lot_no": None}, {}]), masters, lot_dictionary(date(2026, 1, 1)))
    assert "filter(mapped" in below_joins(found)
    assert sorted((f.rule_id, f.source_row) for f in found.collect()) == [("V006", 1), ("V012", 1)]


def test_facts_get_their_names_after_the_exchanges(spark):
    silver = lines(spark, [{}, {"item_no": None}, {"item_no": "ZZ"}])
    queue = spark.createDataFrame([(f"e{i}", "V009", "b1", i) for i in (1, 1, 2, 3, 4)],
                                  "exception_id string, rule_id string, batch_id string, source_row int")
    bronze = silver.select("batch_id", "source_row", "source", F.lit("h").alias("header_hash"), F.create_map(
        F.lit("UOM"), F.concat(F.lit("u"), F.col("source_row").cast("string")), F.lit("more"), F.lit("x")).alias("record"))
    versions = spark.createDataFrame([(1, "plt01", "h", "confirmed", "UOM", "uom", []), (1, "plt01", "h", "confirmed", "LOT", "lot_no", [])],
                                     "mapping_version_id int, source string, header_hash string, status string, source_col string, "
                                     "canonical_col string, transforms array<string>")
    items = spark.createDataFrame([("IT1", "case")], "item_no string, uom string")
    facts = policy.exception_facts(queue, silver, bronze, ingest.confirmed_columns(versions), items)
    assert not any(x in below_joins(facts) for x in ("map_from_arrays", "transform_values"))
    got = sorted((f.exception_id, f.row["item_no"], f.row["ordered_qty"], sorted(f.raw.items()), f.master_uom) for f in facts.collect()
                 if f.row["item_no"])
    raw = lambda i: [("lot_no", None), ("uom", f"u{i}")]
    assert got == [("e1", "IT1", "10.0", raw(1), "CASE")] * 2 + [("e3", "ZZ", "10.0", raw(3), None)]
    blank = facts.where("exception_id = 'e2'").first()
    assert len(blank.row) == len(COLUMNS) and blank.row["item_no"] is None and blank.master_uom is None and facts.count() == 4
