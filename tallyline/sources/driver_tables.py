"""Order lines, masters, batches and raw extracts projected from the TPC-H style tables.

Each projection is a list of SQL expressions that Spark and a checking engine read alike, so a query and its
check start from the same rows. Fault rows (unknown keys, reversed dates, odd units, blanks) are projected in by
arithmetic on the keys; no row is dropped. The row position is a sortable text key rather than a running
number: it needs no shuffle, whatever the number of files.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.schema import FieldDictionary, lot_dictionary
from tallyline.session import fresh_path

LOT_START = "1999-06-01"  # the lot requirement's first day on these tables


def dictionary() -> FieldDictionary:
    return lot_dictionary(date.fromisoformat(LOT_START))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table that arrives in fewer pieces than there are cores (one file, one row group) is dealt out once, so that
    the work above the scan uses them all. A table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def _pad(x: str, n: int) -> str:
    return f"case when length(cast({x} as string)) < {n} then lpad(cast({x} as string), {n}, '0') else cast({x} as string) end"


# Case weights vary around the item's average. Exact decimals: no engine rounds them differently.
_WEIGHT = ("cast(l_quantity * lb_per_case as decimal(9,0)) "
           "* cast(1 + ((l_partkey % 7) - 3) * 0.001e0 as decimal(5,3))")
_UNIT = "case when kg_fault then 2.2046226218e0 else 1e0 end"

# One list per projection level; a later level may use the names of an earlier one.
LEVELS: list[list[str]] = [
    [
        "cast(1 + l_suppkey % 3 as string) as site",
        f"concat('SO', {_pad('l_orderkey', 12)}) as order_no",
        "l_linenumber as line_no",
        "case when l_orderkey % 97 = 0 then null "
        "when l_orderkey % 89 = 0 then concat('C', cast(900000000000 + o_custkey as string)) "
        f"else concat('C', {_pad('o_custkey', 6)}) end as customer_no",
        f"concat(case when l_partkey % 83 = 0 then 'IX' else 'IT' end, {_pad('l_partkey', 5)}) as item_no",
        "cast(o_orderdate as date) as order_date",
        "cast(cast(o_orderdate as date) + cast(3 + l_partkey % 12 as int) as date) as requested_date",
        "cast(10 + p_size as double) as lb_per_case",
        "case when p_size % 10 = 0 then 'LB' else 'CASE' end as master_uom",
        "substr(cast(cast(o_orderdate as date) as string), 1, 4) as order_year",
        f"concat({_pad('l_orderkey', 12)}, cast(l_linenumber as string), "
        f"{_pad('l_partkey', 11)}, {_pad('l_suppkey', 9)}, "
        "cast(cast(l_shipdate as date) as string)) as source_row",
        "case when (l_orderkey + l_partkey) % 401 = 0 then 0e0 else l_quantity end as ordered_qty",
        "cast(case when l_returnflag = 'R' then floor(l_quantity * (1 - l_discount)) else l_quantity end as double)"
        " * case when (l_orderkey + l_linenumber) % 211 = 0 then -1 else 1 end as invoiced_qty",
        "case when o_orderpriority = '1-URGENT' then 'RUSH' when o_orderpriority = '5-LOW' then 'CONS' "
        "else 'STD' end as order_type",
        "case when (l_orderkey + l_partkey) % 307 = 0 then '31/31/2020' end as bad_issue",
        "(l_partkey % 67 = 0 and l_linenumber % 2 = 0) as kg_fault",
    ],
    [
        "concat('plt0', site) as source",
        "concat('PLT-0', site) as plant",
        "concat('plt0', site, ':', order_year) as batch_id",
        "cast(requested_date + cast(case when l_linenumber % 6 = 0 then 1 + l_suppkey % 3 else 0 end as int) as date)"
        " as confirmed_delivery_date",
        "(site <> '1' or order_year >= '1999') as has_lot",
        f"cast(cast(cast({_WEIGHT} as decimal(18,4)) / {_UNIT} as decimal(18,4)) as double) as ordered_weight_lb",
        f"cast(cast(cast({_WEIGHT} * cast(1 - l_discount / 4 as decimal(6,4)) "
        "* case when (l_partkey + l_linenumber) % 173 = 0 then cast(1.2 as decimal(3,1)) "
        f"else cast(1 as decimal(3,1)) end as decimal(18,4)) / {_UNIT} as decimal(18,4)) as double) "
        "as invoiced_weight_lb",
        "case when kg_fault then 'KG' else master_uom end as uom",
    ],
    [
        "case when bad_issue is not null then null "
        "when l_partkey % 101 = 0 then cast(order_date - 2 as date) "
        "else cast(confirmed_delivery_date + cast(case when l_tax >= 0.07 then 1 + cast(l_quantity as int) % 6 "
        "else 0 end as int) as date) end as issue_date",
        "case when not has_lot or l_orderkey % 59 = 0 then null "
        "when l_orderkey % 61 = 0 then concat('LX', cast(l_partkey as string)) "
        "else concat('L', cast(l_partkey as string), '-', cast(l_orderkey % 4 as string)) end as lot_no",
    ],
]
LINE_COLUMNS = [
    "batch_id", "source", "source_row", "order_no", "line_no", "customer_no", "item_no", "plant", "order_date",
    "requested_date", "confirmed_delivery_date", "issue_date", "ordered_qty", "invoiced_qty",
    "ordered_weight_lb", "invoiced_weight_lb", "uom", "lot_no", "has_lot", "bad_issue", "order_type",
]
CUSTOMER_EXPRS = [
    f"concat('C', {_pad('c_custkey', 6)}) as customer_no", "c_name as customer_name",
    "concat('City ', cast(c_nationkey as string)) as city", "c_mktsegment as channel",
]
ITEM_EXPRS = [
    f"concat('IT', {_pad('p_partkey', 5)}) as item_no", "p_name as item_name", "p_type as product_group",
    "(p_type <> 'STANDARD') as catch_weight_flag", "cast(10 + p_size as double) as avg_lb_per_case",
    "case when p_size % 10 = 0 then 'LB' else 'CASE' end as uom",
]
LOT_EXPRS = [
    "concat('L', cast(p_partkey as string), '-', cast(k as string)) as lot_no",
    f"concat('IT', {_pad('p_partkey', 5)}) as item_no",
    "concat('PLT-0', cast(1 + p_partkey % 3 as string)) as plant",
    "cast(date '1994-06-01' + cast(k * 600 + p_partkey % 200 as int) as date) as production_date",
    "cast(date '1994-06-01' + cast(2300 + k * 1000 + p_partkey % 200 as int) as date) as expiry_date",
]
# The text each plant sends for a canonical column; %(…)s marks the day count, the one piece the engines spell
# differently.
_DATE_TEXT = ("case site when '1' then cast({c} as string) when '2' then concat(substr(cast({c} as string), 6, 2), "
              "'/', substr(cast({c} as string), 9, 2), '/', substr(cast({c} as string), 1, 4)) "
              "else cast({days} as string) end")
_KG = "2.2046226218e0"


def raw_exprs(engine: str) -> list[str]:
    """Text columns r_<canonical>, as the three plants write them (ISO/US/serial dates, lb/kg, key prefixes)."""

    def days(c: str) -> str:
        epoch = "date '1899-12-30'"
        return f"datediff({c}, {epoch})" if engine == "spark" else f"({c} - {epoch})"

    def date_text(c: str) -> str:
        return _DATE_TEXT.format(c=c, days=days(c))

    def weight(c: str) -> str:
        return (f"case when site = '2' and l_orderkey % 101 = 0 then '' when site = '2' then "
                f"cast(cast({c} / {_KG} as decimal(18,4)) as string) else cast(cast({c} as decimal(18,4)) "
                "as string) end")

    return [
        "order_no as r_order_no", "cast(line_no as string) as r_line_no",
        "case when customer_no is null then '' when site = '1' then customer_no when site = '2' then "
        "cast(cast(substr(customer_no, 2) as bigint) as string) else concat('CUST-', substr(customer_no, 2)) end "
        "as r_customer_no",
        "case when site = '3' and l_partkey % 29 = 0 then concat(item_no, '  ') else item_no end as r_item_no",
        "plant as r_plant",
        f"{date_text('order_date')} as r_order_date",
        f"{date_text('requested_date')} as r_requested_date",
        f"{date_text('confirmed_delivery_date')} as r_confirmed_delivery_date",
        f"coalesce(bad_issue, {date_text('issue_date')}) as r_issue_date",
        "cast(cast(ordered_qty as int) as string) as r_ordered_qty",
        "cast(cast(invoiced_qty as int) as string) as r_invoiced_qty",
        f"{weight('ordered_weight_lb')} as r_ordered_weight_lb",
        f"{weight('invoiced_weight_lb')} as r_invoiced_weight_lb",
        "uom as r_uom", "coalesce(lot_no, '') as r_lot_no",
    ]


# Header each plant uses, in file order; a None year bound is open. plt02 renames its customer column in 1998 and
# plt01 starts to send a lot column in 1999.
_PLT01 = ["ord_no", "ln", "cust_no", "itm_no", "fac", "ord_dt", "req_dt", "cfm_dlv_dt", "iss_dt", "ord_qty",
          "inv_qty", "ord_wt", "inv_wt", "uom_cd"]
_PLT02 = ["ORDERNUM", "ORDERLINE", "cust_no", "ITEMID", "FACILITY", "DT_ORDER", "DT_REQ", "DT_CONFIRM", "DT_SHIP",
          "QTY_ORD", "QTY_SHIP", "WT_ORD_KG", "WT_SHIP_KG", "UOM", "LOTID"]
_PLT03 = ["Order", "Line", "Customer", "Item", "Plant", "OrderDate", "RequestDate", "PromiseDate", "ShipDate",
          "QtyOrdered", "QtyShipped", "WeightOrdered", "WeightShipped", "UnitOfMeasure", "Lot"]
HEADERS = [
    ("plt01", "0000", "1999", _PLT01),
    ("plt01", "1999", "9999", [*_PLT01, "lot_no"]),
    ("plt02", "0000", "1998", _PLT02),
    ("plt02", "1998", "9999", [*_PLT02[:2], "customer_number", *_PLT02[3:]]),
    ("plt03", "0000", "9999", _PLT03),
]
TRANSFORMS_BY_SOURCE = {
    "plt01": {"date": "parse_date_iso", "weight": None, "customer": None, "item": None},
    "plt02": {"date": "parse_date_us", "weight": "kg_to_lb", "customer": "normalize_customer_no", "item": None},
    "plt03": {"date": "parse_excel_serial", "weight": None, "customer": "normalize_customer_no", "item": "trim"},
}


def _joined(spark: SparkSession, d: str) -> DataFrame:
    lines, orders, parts = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    lines = spread(lines, "l_orderkey", "l_linenumber", "l_partkey")
    joined = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(parts, F.col("l_partkey") == F.col("p_partkey")))
    for level in LEVELS:
        joined = joined.selectExpr("*", *level)
    return joined


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Silver-shaped lines with the projection's helper columns (has_lot, bad_issue, order_type)."""
    return _joined(spark, d).select(*LINE_COLUMNS)


def silver(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as the rules read them: typed columns, parse_errors and the columns the mapping supplies. A stored
    table, as in the pipeline: what reads it does not join its sources again."""
    return stored(spark, d, "silver", lambda: _silver(spark, d))


def _silver(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.schema import COLUMNS

    no_lot = [c for c in COLUMNS if c != "lot_no"]
    errors = F.when(F.col("bad_issue").isNotNull(), F.create_map(F.lit("issue_date"), F.col("bad_issue"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    mapped = F.when(F.col("has_lot"), F.array(*[F.lit(c) for c in COLUMNS])) \
        .otherwise(F.array(*[F.lit(c) for c in no_lot]))
    return order_lines(spark, d).select(
        "batch_id", "source", "source_row", *COLUMNS, errors.alias("parse_errors"), mapped.alias("mapped"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(*CUSTOMER_EXPRS)


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*ITEM_EXPRS)


def plants(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "supplier")
            .selectExpr("concat('PLT-0', cast(1 + s_suppkey % 3 as string)) as plant").distinct())


def lots(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
            .selectExpr(*LOT_EXPRS))


BATCH_EXPRS = [
    "batch_id", "source", "order_year",
    "concat(source, '_orderlines_', order_year, '-01.csv') as file_name",
    "row_count",
    # plt01 arrives after plt02 and plt03, so publishing in name order meets lines a later batch already holds
    "cast(cast(concat(order_year, '-01-0', case source when 'plt01' then '4' when 'plt02' then '2' else '3' end) "
    "as date) as string) as received_at",
    "case when source = 'plt03' and order_year = '1996' then true else false end as stale",
    "case when source = 'plt02' and order_year = '2001' then 'blocked' else 'validated' end as status",
    "case when source = 'plt01' then case when order_year < '1999' then 'plt01-a' else 'plt01-b' end "
    "when source = 'plt02' then case when order_year < '1998' then 'plt02-a' else 'plt02-b' end "
    "else 'plt03-a' end as header_hash",
]


def batches(spark: SparkSession, d: str) -> DataFrame:
    """One row per extract (source and order year) with its state, as the batch log holds it; a stored table."""
    return stored(spark, d, "batches", lambda: _batches(spark, d))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    counted = (_joined(spark, d).groupBy("batch_id", "source", "order_year")
               .agg(F.count(F.lit(1)).alias("row_count")))
    return counted.selectExpr(*BATCH_EXPRS)


def raw_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line as text, canonical column names prefixed r_, with its batch and position."""
    return _joined(spark, d).selectExpr("batch_id", "source", "order_year", "has_lot", "source_row",
                                        *raw_exprs("spark"))


def raw_names() -> list[str]:
    from tallyline.schema import COLUMNS

    return [f"r_{c}" for c in COLUMNS]


def header_of(source: str, year: str) -> list[str]:
    return next(h for s, lo, hi, h in HEADERS if s == source and lo <= year < hi)


_stored: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session to the shared folder and read from there afterwards."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        path = fresh_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def bronze(spark: SparkSession, d: str) -> DataFrame:
    """Bronze rows: the file's own header names as map keys, text values, nothing typed. Bronze is a stored table:
    whatever reads it starts from its files, not from the projection that made it."""
    return stored(spark, d, "bronze", lambda: _bronze(spark, d))


def _bronze(spark: SparkSession, d: str) -> DataFrame:
    raw = raw_lines(spark, d)
    names, label = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for source, lo, hi, header in HEADERS:
        hit = (F.col("source") == source) & (F.col("order_year") >= lo) & (F.col("order_year") < hi)
        names = F.when(hit, F.array(*[F.lit(h) for h in header])).otherwise(names)
        label = F.when(hit, F.lit(f"{source}-{'a' if lo == '0000' else 'b'}")).otherwise(label)
    # the values once, whatever the header: a header only names a prefix of them
    named = raw.select("batch_id", "source", "order_year", "source_row", label.alias("header_hash"),
                       names.alias("_names"), F.array(*raw_names()).alias("_values"))
    return named.select("batch_id", "source", "order_year", "source_row", "header_hash", F.map_from_arrays(
        "_names", F.slice("_values", F.lit(1), F.size("_names"))).alias("record"))


def mapping_versions(spark: SparkSession, d: str) -> DataFrame:
    """One confirmed mapping per header, plus a superseded and a proposed one, as rows per source column.

    The table is configuration: its size is the number of headers, not of rows.
    """
    from tallyline.schema import COLUMNS, KIND

    rows, ids = [], {}
    for n, (source, lo, _, header) in enumerate(HEADERS, start=1):
        ids[n] = source
        steps = TRANSFORMS_BY_SOURCE[source]
        label = f"{source}-{'a' if lo == '0000' else 'b'}"
        for pos, (name, canonical) in enumerate(zip(header, COLUMNS)):
            chosen = [t for t in [steps.get(KIND[canonical])] if t]
            rows.append((n, source, n, label, "confirmed", "human", pos, name, canonical, chosen))
    rows.append((6, "plt01", 6, "plt01-a", "superseded", "heuristic", 0, "ord_ref", "order_no", []))
    rows.append((7, "plt03", 7, "plt03-a", "proposed", "heuristic", 0, "Order", "order_no", ["trim"]))
    return spark.createDataFrame(rows, (
        "mapping_version_id int, source string, version int, header_hash string, status string, "
        "proposed_by string, position int, source_col string, canonical_col string, "
        "transforms array<string>"))


# ---- the same projections as common table expressions for the checking engine --------------------------------

def _nested(base: str) -> str:
    text = base
    for level in LEVELS:
        text = f"select *, {', '.join(level)} from ({text}) _"
    return text


def _cells() -> str:
    from tallyline.schema import COLUMNS

    parts = []
    for i, c in enumerate(COLUMNS):
        three = [(_PLT01 + ["lot_no"])[i], _PLT02[i], _PLT03[i]]
        second = f"case when order_year >= '1998' then 'customer_number' else '{three[1]}' end" if i == 2 \
            else f"'{three[1]}'"
        keep = " where has_lot" if c == "lot_no" else ""
        parts.append(f"select batch_id, source, source_row, {i} as position, case source when 'plt01' then "
                     f"'{three[0]}' when 'plt02' then {second} else '{three[2]}' end as col, r_{c} as value from raw"
                     f"{keep}")
    return " union all ".join(parts)


CTES: dict[str, tuple[list[str], str]] = {
    "wide": ([], _nested(
        "select * from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey")),
    "ol": (["wide"], f"select {', '.join(LINE_COLUMNS)} from wide"),
    "custs": ([], f"select {', '.join(CUSTOMER_EXPRS)} from customer"),
    "its": ([], f"select {', '.join(ITEM_EXPRS)} from part"),
    "lts": ([], f"select {', '.join(LOT_EXPRS)} from part cross join (select unnest([0,1,2,3]) as k) ks"),
    "plts": ([], "select distinct concat('PLT-0', cast(1 + s_suppkey % 3 as string)) as plant from supplier"),
    "bts": (["wide"], f"select {', '.join(BATCH_EXPRS)} from (select batch_id, source, order_year, "
                      "count(*) as row_count from wide group by 1, 2, 3) _"),
    "raw": (["wide"], "select batch_id, source, order_year, has_lot, source_row, "
                      f"{', '.join(raw_exprs('duck'))} from wide"),
    "cells": (["raw"], _cells()),
}
