"""Metrics, consumer views, reconciliation and the reporting tools' exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import feeds
from tallyline.operators import metrics as m
from tallyline.operators import reconcile as rc
from tallyline.plans.common import clean_lines, round6
from tallyline.plans.registry import cte, query

_RATE = lambda n: f"round(count(*) filter (where {n}) / cast(count(*) as double), 6)"


def _rates_sql(on: str, full: str, group: str, names: list[str]) -> str:
    cells = {
        "lines": "cast(count(*) as bigint)", "otif_lines": f"cast(count(*) filter (where {on} and {full}) as bigint)",
        "on_time_lines": f"cast(count(*) filter (where {on}) as bigint)",
        "in_full_lines": f"cast(count(*) filter (where {full}) as bigint)",
        "otif_rate": _RATE(f"{on} and {full}"), "on_time_rate": _RATE(on), "in_full_rate": _RATE(full)}
    return f"select {group}, {', '.join(f'{cells[n]} as {n}' for n in names)} from flags group by all"


ALL = ["lines", "otif_lines", "on_time_lines", "in_full_lines", "otif_rate", "on_time_rate", "in_full_rate"]
RATES = ["otif_rate", "on_time_rate", "in_full_rate"]


def _metric(spark: SparkSession, d: str, name: str, version: int, by: list[str]) -> DataFrame:
    out = m.aggregate(clean_lines(spark, d), m.BY_VERSION[(name, version)], by)
    if "day" in out.columns:
        out = out.withColumn("day", F.col("day").cast("string"))
    return round6(out, *[c for c in RATES if c in out.columns])


@query("a01_grouped_metric", ["flags"], _rates_sql("gov_on_time", "gov_in_full",
       "cast(issue_date as varchar) as day, plant, product_group", ALL))
def grouped_metric(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, "otif", 3, ["day", "plant", "product_group"])


@query("a02_otif_v3_by_customer", ["flags"], _rates_sql("gov_on_time", "gov_in_full", "month, customer_no", ALL))
def otif_v3(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, "otif", 3, ["month", "customer_no"])


@query("a03_otif_v2", ["flags"], _rates_sql("gov_on_time", "count_in_full", "month, plant", ALL))
def otif_v2(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, "otif", 2, ["month", "plant"])


@query("a04_otif_date_basis", ["flags"], _rates_sql("req_on_time", "gov_in_full", "month, plant",
                                                    ["lines", "otif_lines", "otif_rate"]))
def otif_date_basis(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, "otif_date_basis", 1, ["month", "plant"])


@query("a05_otif_case_tolerance", ["flags"], _rates_sql("gov_on_time", "tol_in_full", "month, plant",
                                                        ["lines", "otif_lines", "otif_rate"]))
def otif_case_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return _metric(spark, d, "otif_case_tolerance", 1, ["month", "plant"])


_FILL = """cast(count(*) as bigint) as lines, round(sum(invoiced_qty) / nullif(sum(ordered_qty), 0), 6) as
    fill_rate_count, round(sum(invoiced_weight_lb) / nullif(sum(ordered_weight_lb), 0), 6) as fill_rate_weight,
    round(sum(ordered_weight_lb), 4) as ordered_weight_lb, round(sum(invoiced_weight_lb), 4) as invoiced_weight_lb,
    sum(ordered_qty) as ordered_qty, sum(invoiced_qty) as invoiced_qty"""


def _round_fill(df: DataFrame) -> DataFrame:
    return round6(df, "fill_rate_count", "fill_rate_weight").withColumns(
        {c: F.round(c, 4) for c in ("ordered_weight_lb", "invoiced_weight_lb")})


@query("a06_fill_rate", ["fact"], f"""select substr(cast(issue_date as varchar), 1, 7) as month, plant, {_FILL} from
    fact group by 1, 2""")
def fill_rate(spark: SparkSession, d: str) -> DataFrame:
    return _round_fill(_metric(spark, d, "fill_rate", 1, ["month", "plant"]))


@query("a07_consumer_views", ["flags"], """
    select 'ops_otif_monthly_plant' as view_name, concat_ws('|', month, plant) as grain, cast(count(*) as bigint) as
      lines from flags group by month, plant
    union all select 'sales_otif_daily_customer', concat_ws('|', cast(issue_date as varchar), plant, customer_no),
      cast(count(*) as bigint) from flags group by issue_date, plant, customer_no
    union all select 'legacy_otif_monthly_plant', concat_ws('|', month, plant), cast(count(*) as bigint) from flags
      group by month, plant
    union all select 'ops_fill_rate_monthly_plant', concat_ws('|', month, plant), cast(count(*) as bigint) from flags
      group by month, plant
    union all select 'sales_fill_rate_daily_customer', concat_ws('|', cast(issue_date as varchar), plant, customer_no),
      cast(count(*) as bigint) from flags group by issue_date, plant, customer_no""")
def consumer_views(spark: SparkSession, d: str) -> DataFrame:
    fact, out = clean_lines(spark, d), None
    for name, (_, _, by) in m.CONSUMERS.items():
        part = m.consumer(fact, name).select(
            F.lit(name).alias("view_name"),
            F.concat_ws("|", *[F.col(g).cast("string") for g in by]).alias("grain"), "lines")
        out = part if out is None else out.unionByName(part)
    return out


@query("a09_rollup_to_month", ["flags"], """select month, plant, cast(count(*) filter (where gov_on_time and
    gov_in_full) as bigint) as num, cast(count(*) as bigint) as den from flags group by 1, 2""")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    daily = m.consumer(clean_lines(spark, d), "sales_otif_daily_customer")
    return rc.rollup(daily, ["month", "plant"], "otif_lines", "lines")


PAIR = """with o as (select month, plant, count(*) filter (where gov_on_time and gov_in_full) / cast(count(*) as
    double) as v, count(*) filter (where gov_on_time and count_in_full) / cast(count(*) as double) as l from flags
    group by 1, 2), f as (select month, plant, sum(invoiced_weight_lb) / nullif(sum(ordered_weight_lb), 0) as v
    from flags group by 1, 2), both_pairs as (select 'otif' as metric, month as period, concat('plant=', plant) as
    grain_key, v as value_a, v as value_b, l as value_legacy, l - v as legacy_delta from o union all select 'fill_rate',
    month, concat('plant=', plant), v, v, null, null from f)"""


@query("a10_compare_consumers", ["flags"], PAIR + """ select metric, period, grain_key, round(value_a, 6) as value_a,
    round(value_b, 6) as value_b, cast(0 as double) as delta, round(value_legacy, 6) as value_legacy,
    round(legacy_delta, 6) as legacy_delta, case when value_a is null then 'red' else 'green' end as status
    from both_pairs""")
def compare(spark: SparkSession, d: str) -> DataFrame:
    out = rc.compare_consumers(clean_lines(spark, d)).drop("consumer_a", "consumer_b", "legacy")
    return round6(out.withColumn("delta", F.abs("delta")), "value_a", "value_b", "delta", "value_legacy",
                  "legacy_delta")


@query("j07_full_outer_grain", ["flags"], """select coalesce(a.month, b.month) as month, coalesce(a.plant, b.plant) as
    plant, a.n as ours, b.n as theirs from (select month, plant, cast(count(*) as bigint) as n from flags where
    gov_on_time group by 1, 2) a full join (select month, plant, cast(count(*) as bigint) as n from flags where not
    gov_in_full group by 1, 2) b on a.month is not distinct from b.month and a.plant is not distinct from b.plant""")
def full_outer(spark: SparkSession, d: str) -> DataFrame:
    flags = rc.line_flags(clean_lines(spark, d))
    a = flags.where("gov_on_time").groupBy("month", "plant").agg(F.count(F.lit(1)).alias("ours"))
    b = flags.where("not gov_in_full").groupBy("month", "plant").agg(F.count(F.lit(1)).alias("theirs"))
    return rc.full_on_nulls(a, b, ["month", "plant"])


@query("a39_legacy_gap_summary", ["flags"], PAIR + """ select cast(count(*) filter (where legacy_delta <> 0) as bigint)
    as rows_different, round_even(max(abs(legacy_delta)), 4) as max_gap from both_pairs where metric = 'otif'""")
def legacy_gap(spark: SparkSession, d: str) -> DataFrame:
    rows = rc.compare_consumers(clean_lines(spark, d)).where("metric = 'otif'")
    return rows.agg(F.count_if(F.col("legacy_delta") != 0).alias("rows_different"),
                    F.bround(F.max(F.abs("legacy_delta")), 4).alias("max_gap"))


@query("a37_period_grid", ["flags"], PAIR + """ select period, max(case when grain_key = 'plant=PLT-01' then
    round(legacy_delta, 6) end) as "PLT-01", max(case when grain_key = 'plant=PLT-02' then round(legacy_delta, 6) end)
    as "PLT-02", max(case when grain_key = 'plant=PLT-03' then round(legacy_delta, 6) end) as "PLT-03"
    from both_pairs where metric = 'otif' group by 1""")
def period_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = rc.compare_consumers(clean_lines(spark, d)).where("metric = 'otif'")
    grid = rows.groupBy("period").pivot("grain_key").agg(F.avg("legacy_delta"))  # every plant there is
    return grid.select("period", *[F.round(F.col(f"`{c}`"), 6).alias(c.removeprefix("plant=")) for c in grid.columns[1:]])


# ---- the two exports and what explains them ------------------------------------------------------------------

cte("feed1", ["flags"], """select *, (gov_on_time) as t1_on_time, coalesce(round_even(least(invoiced_qty /
    case when ordered_qty > 0 then ordered_qty end, case when ordered_qty > 0 then 1 end), 4) >= 1, false) as t1_in_full
    from flags""")
cte("feed2", ["flags"], """select month, plant, customer_no, customer_name, cast(count(*) as bigint) as lines,
    cast(count(*) filter (where req_on_time) as bigint) as on_time_lines, cast(count(*) filter (where tol_in_full) as
    bigint) as in_full_lines, cast(count(*) filter (where req_on_time and tol_in_full) as bigint) as otif_lines,
    sum(ordered_qty) as ordered_cases, sum(invoiced_qty) as shipped_cases from flags where order_type <> 'CONS'
    group by 1, 2, 3, 4""")
_CELL = "concat_ws('_', o, f, case when x then '1' else '0' end)"
cte("scored", ["flags", "feed2"], """select o, f, x, cast(count(*) as bigint) as total, cast(count(*) filter (where
    e.lines = a.n and e.otif_lines = a.k) as bigint) as matches from (select * from (values ('confirmed'),
    ('requested')) a(o), (values ('governed'), ('count'), ('count_tolerance')) b(f), (values (false), (true)) c(x)) d
    cross join feed2 e left join (select o as ao, f as af, x as ax, month, plant, customer_no, count(*) as n,
      count(*) filter (where case o when 'confirmed' then gov_on_time else req_on_time end and case f when 'governed'
      then gov_in_full when 'count' then count_in_full else tol_in_full end) as k from flags cross join (select * from
      (values ('confirmed'), ('requested')) a(o), (values ('governed'), ('count'), ('count_tolerance')) b(f),
      (values (false), (true)) c(x)) d where not (x and order_type = 'CONS') group by 1, 2, 3, 4, 5, 6) a
    on ao = o and af = f and ax = x and a.month = e.month and a.plant = e.plant and a.customer_no = e.customer_no
    group by 1, 2, 3""")


def line_feed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.line_report(clean_lines(spark, d), "Example Foods")


def flags_and_line_export(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fact = clean_lines(spark, d)
    verdicts = feeds.line_verdicts(feeds.line_report(fact, "Example Foods"))
    flags = rc.line_flags(fact.drop("order_type").withColumn("order_type", F.lit(None).cast("string")),
                          verdicts.withColumn("position", F.lit(1)))
    return flags, verdicts.select("order_no", "line_no", "tool_on_time", "tool_in_full", "issue_date")


def monthly_export(spark: SparkSession, d: str) -> DataFrame:
    return feeds.monthly_report(clean_lines(spark, d))


@query("a29_line_report", ["feed1"], """select order_no as "Customer Order Number", line_no as "Order Line Number",
    customer_no as "Customer Number", customer_name as "Customer Name", city as "City", order_type as
    "Customer Order Type", item_no as "Item Number", item_name as "Item Name", product_group as "Product Group",
    cast(confirmed_delivery_date as varchar) as "Confirmed Delivery Date", cast(requested_date as varchar) as
    "Planning Date", cast(issue_date as varchar) as "Issue Date", cast(issue_date - requested_date as integer) as
    "Days Between Planning and Issue Date", ordered_qty as "Ordered Qty", invoiced_qty as "Invoiced Qty",
    round_even(invoiced_qty / case when ordered_qty > 0 then ordered_qty end, 4) as "Case Fill Rate",
    round_even(least(invoiced_qty / case when ordered_qty > 0 then ordered_qty end, case when ordered_qty > 0 then
    cast(1 as double) end), 4) as "Case Fill Rate max. 100%", case when gov_on_time then 'Y' else 'N' end as "On Time",
    'Example Foods' as "Company Name", cast(null as varchar) as "Customer PO Number" from feed1""")
def line_report(spark: SparkSession, d: str) -> DataFrame:
    out = line_feed(spark, d)
    return out.withColumns({c: F.col(c).cast("string") for c in
                            ("Confirmed Delivery Date", "Planning Date", "Issue Date")})


@query("a30_monthly_report", ["feed2"], """select *, round_even(100 * otif_lines / cast(lines as double), 1) as otif_pct,
    round_even(100 * on_time_lines / cast(lines as double), 1) as on_time_pct, round_even(100 * shipped_cases /
    nullif(ordered_cases, 0), 1) as fill_pct from feed2""")
def monthly_report(spark: SparkSession, d: str) -> DataFrame:
    return monthly_export(spark, d)


@query("j06_line_flags", ["feed1"], """select order_no, line_no, month, plant, customer_no, gov_on_time, gov_in_full,
    count_in_full, req_on_time, tol_in_full, order_type from feed1""")
def line_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags_and_line_export(spark, d)[0]


@query("j08_line_match", ["feed1"], """select month, cast(count(*) as bigint) as lines, cast(count(*) filter (where
    t1_on_time = gov_on_time) as bigint) as on_time_agree, cast(count(*) filter (where t1_in_full = gov_in_full) as
    bigint) as in_full_agree from feed1 group by 1""")
def line_match(spark: SparkSession, d: str) -> DataFrame:
    flags, verdicts = flags_and_line_export(spark, d)
    return flags.join(verdicts.drop("issue_date"), ["order_no", "line_no"]).groupBy("month").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("tool_on_time") == F.col("gov_on_time")).alias("on_time_agree"),
        F.count_if(F.col("tool_in_full") == F.col("gov_in_full")).alias("in_full_agree"))


@query("j09_group_match", ["scored"], "select o as on_time, f as in_full, x as excludes_consignment, total, matches "
                                      "from scored")
def group_match(spark: SparkSession, d: str) -> DataFrame:
    fact = clean_lines(spark, d)
    return rc.definition_scores(rc.line_flags(fact), feeds.monthly_report(fact))


@query("a11_identify_monthly_tool", ["scored"], """select o as on_time, f as in_full, x as excludes_consignment,
    round(matches / cast(total as double), 6) as match_share from scored where matches = (select max(matches) from
    scored)""")
def identify_monthly(spark: SparkSession, d: str) -> DataFrame:
    fact = clean_lines(spark, d)
    return round6(rc.identify_aggregate_tool(rc.line_flags(fact), feeds.monthly_report(fact)), "match_share")


_T1 = """with s as (select count(*) as n, count(*) filter (where gov_on_time = t1_on_time) as on_c, count(*) filter (
    where req_on_time = t1_on_time) as on_r, count(*) filter (where gov_in_full = t1_in_full) as f_g, count(*) filter
    (where count_in_full = t1_in_full) as f_c, count(*) filter (where tol_in_full = t1_in_full) as f_t from feed1),
    c1 as (select o, f, n, greatest(on_c, on_r) as bo, greatest(f_g, f_c, f_t) as bf from s, (values ('confirmed'),
    ('requested')) a(o), (values ('governed'), ('count'), ('count_tolerance')) b(f) where (case o when 'confirmed' then
    on_c else on_r end) = greatest(on_c, on_r) and (case f when 'governed' then f_g when 'count' then f_c else f_t end)
    = greatest(f_g, f_c, f_t))"""


@query("a12_identify_line_tool", ["feed1"], _T1 + """ select o as on_time, f as in_full, false as excludes_consignment,
    round(least(bo, bf) / cast(n as double), 6) as match_share from c1""")
def identify_lines(spark: SparkSession, d: str) -> DataFrame:
    flags, verdicts = flags_and_line_export(spark, d)
    return round6(rc.identify_line_tool(flags, verdicts.drop("issue_date")), "match_share")


_CAUSE_LIST = """list_filter([case when {n1} then 'weight_basis' end, case when {n2} then 'date_basis' end, case when
    {n3} then 'case_tolerance' end, case when {n4} then 'scope_filter' end], lambda c: c is not null)"""


def _causes_sql(source: str) -> str:
    tests = ["f <> 'governed'", "o = 'requested'", "f = 'count_tolerance'", "x"]
    cells = ", ".join(f"count(*) filter (where {t}) as c{i}" for i, t in enumerate(tests, 1))
    full = _CAUSE_LIST.format(**{f"n{i}": f"c{i} = n and n > 0" for i in range(1, 5)})
    part = _CAUSE_LIST.format(**{f"n{i}": f"c{i} > 0 and c{i} < n" for i in range(1, 5)})
    return (f"(select {full} as identified, {part} as undetermined from (select count(*) as n, {cells} from {source}) "
            "q)")


_BEST2 = "(select o, f, x from scored where matches = (select max(matches) from scored)) b"
_BEST1 = "(select o, f, false as x from c1) b"
_MONTHLY2 = f"""m as (select month, count(*) as lg, avg((gov_on_time and gov_in_full)::int) as g,
    avg((gov_on_time and count_in_full)::int) as w, avg((req_on_time and gov_in_full)::int) as d,
    avg((gov_on_time and tol_in_full)::int) as t from flags group by 1),
  e as (select month, sum(lines) as lt, sum(otif_lines) / cast(sum(lines) as double) as r from feed2 group by 1),
  z as (select *, list_concat(identified, undetermined) as sized from {_causes_sql(_BEST2)} k),
  att as (select m.month as period, cast(lg as bigint) as lines_governed, cast(coalesce(lt, 0) as bigint) as lines_tool,
    g as governed, r as measured, r - g as gap, coalesce(abs(r - g) > 0.001, false) as gap_flagged,
    case when list_contains(sized, 'weight_basis') then round_even(w - g, 5) end as weight_basis,
    case when list_contains(sized, 'date_basis') then round_even(d - g, 5) end as date_basis,
    case when list_contains(sized, 'case_tolerance') then round_even(t - g, 5) end as case_tolerance,
    case when list_contains(sized, 'scope_filter') then cast(lg - coalesce(lt, 0) as double) end as lines_dropped,
    identified from m left join e using (month) cross join z),
  dom as (select *, greatest(case when list_contains(identified, 'weight_basis') then abs(weight_basis) end, case when
    list_contains(identified, 'date_basis') then abs(date_basis) end, case when list_contains(identified,
    'case_tolerance') then abs(case_tolerance) end) as top from att),
  dom2 as (select *, case when list_contains(identified, 'weight_basis') and abs(weight_basis) = top then
    'weight_basis' when list_contains(identified, 'date_basis') and abs(date_basis) = top then 'date_basis' when
    list_contains(identified, 'case_tolerance') and abs(case_tolerance) = top then 'case_tolerance' end as
    dominant_cause from dom)"""


def attributed_monthly(spark: SparkSession, d: str) -> DataFrame:
    fact = clean_lines(spark, d)
    flags, export = rc.line_flags(fact), feeds.monthly_report(fact)
    causes = rc.judge_causes(rc.identify_aggregate_tool(flags, export))
    return rc.attribute(flags, causes, rc.measured_by_groups(export))


@query("a13_cause_sizing", ["flags", "feed2", "scored"], "with " + _MONTHLY2 + """ select period, lines_governed,
    lines_tool, round(governed, 6) as governed, round(measured, 6) as measured, round(gap, 6) as gap, gap_flagged,
    weight_basis, date_basis, case_tolerance, lines_dropped, dominant_cause from dom2""")
def cause_sizing(spark: SparkSession, d: str) -> DataFrame:
    rows = attributed_monthly(spark, d)
    part = lambda k, n=None: F.try_element_at("contributions", F.lit(k)).alias(n or k)
    return round6(rows, "governed", "measured", "gap").select(
        "period", "lines_governed", "lines_tool", "governed", "measured", "gap", "gap_flagged", part("weight_basis"),
        part("date_basis"), part("case_tolerance"), part("scope_filter_lines_dropped", "lines_dropped"),
        "dominant_cause")


@query("a14_identified_causes", ["feed1", "scored"], _T1 + f""" select 'line' as tool, array_to_string(identified, ',')
    as identified, array_to_string(undetermined, ',') as undetermined from {_causes_sql(_BEST1)} a union all select
    'monthly', array_to_string(identified, ','), array_to_string(undetermined, ',') from {_causes_sql(_BEST2)} c""")
def identified_causes(spark: SparkSession, d: str) -> DataFrame:
    flags, verdicts = flags_and_line_export(spark, d)
    tools = {"line": rc.identify_line_tool(flags, verdicts.drop("issue_date")),
             "monthly": rc.identify_aggregate_tool(flags, monthly_export(spark, d))}
    parts = [rc.judge_causes(c).select(F.lit(t).alias("tool"), F.array_join("identified", ",").alias("identified"),
                                       F.array_join("undetermined", ",").alias("undetermined"))
             for t, c in tools.items()]
    return parts[0].unionByName(parts[1])


@query("u07_candidate_cause_sets", ["scored"], """select o as on_time, f as in_full, x as excludes_consignment,
    array_to_string(""" + _CAUSE_LIST.format(n1="f <> 'governed'", n2="o = 'requested'", n3="f = 'count_tolerance'",
                                             n4="x") + f""", ',') as causes from {_BEST2}""")
def candidate_causes(spark: SparkSession, d: str) -> DataFrame:
    fact = clean_lines(spark, d)
    sets = rc.cause_sets(rc.identify_aggregate_tool(rc.line_flags(fact), feeds.monthly_report(fact)))
    return sets.select("on_time", "in_full", "excludes_consignment", F.array_join("causes", ",").alias("causes"))


@query("a15_modal_cause", ["flags", "feed2", "scored"], "with " + _MONTHLY2 + """ select dominant_cause, cast(count(*)
    as bigint) as months from dom2 where dominant_cause is not null group by 1 order by 2 desc, 1 limit 1""")
def modal_cause(spark: SparkSession, d: str) -> DataFrame:
    return rc.modal_cause(attributed_monthly(spark, d))


@query("a16_measured_rates", ["feed1", "feed2"], """select 'line' as tool, month, cast(count(*) as bigint) as lines,
    round(avg((t1_on_time and t1_in_full)::int), 6) as rate from feed1 group by 2 union all select 'monthly', month,
    cast(sum(lines) as bigint), round(sum(otif_lines) / cast(sum(lines) as double), 6) from feed2 group by 2""")
def measured(spark: SparkSession, d: str) -> DataFrame:
    _, verdicts = flags_and_line_export(spark, d)
    out = rc.measured_by_lines(verdicts).withColumn("tool", F.lit("line")).unionByName(
        rc.measured_by_groups(monthly_export(spark, d)).withColumn("tool", F.lit("monthly")))
    return round6(out, "rate").select("tool", "month", "lines", "rate")


@query("a31_monthly_gap_truth", ["flags"], """with g as (select month, count(*) as lines, avg((gov_on_time and
    gov_in_full)::int) as g, avg((gov_on_time and count_in_full)::int) as t1, count(*) filter (where req_on_time and
    tol_in_full and order_type <> 'CONS') / nullif(cast(count(*) filter (where order_type <> 'CONS') as double), 0) as
    t2, avg((req_on_time and gov_in_full)::int) as d, avg((gov_on_time and tol_in_full)::int) as t, count(*) filter
    (where order_type = 'CONS') as c from flags group by 1)
    select month, cast(lines as bigint) as lines, round_even(g, 5) as governed_otif, round_even(t1, 5) as tool1_otif,
    round_even(t2, 5) as tool2_otif, round_even(t1 - g, 5) as tool1_gap, round_even(t2 - g, 5) as tool2_gap,
    round_even(t1 - g, 5) as weight_basis, round_even(d - g, 5) as date_basis, round_even(t - g, 5) as case_tolerance,
    cast(c as bigint) as scope_filter_lines_dropped from g""")
def gap_truth(spark: SparkSession, d: str) -> DataFrame:
    return feeds.gap_truth(clean_lines(spark, d))


@query("f08_flag_columns", ["flags"], """select order_no, line_no, gov_on_time as on_time, count_in_full as in_full_count,
    coalesce(invoiced_weight_lb >= ordered_weight_lb * cast(0.98 as double), false) as in_full_weight, gov_in_full as
    in_full, gov_on_time and gov_in_full as otif from flags""")
def flag_columns(spark: SparkSession, d: str) -> DataFrame:
    out = m.with_flags(clean_lines(spark, d), m.BY_VERSION[("otif", 3)])
    return out.select("order_no", "line_no", "on_time", "in_full_count", "in_full_weight", "in_full", "otif")


@query("f09_metric_expressions", ["fact"], """select plant, cast(count(*) as bigint) as lines, cast(count(*) filter
    (where order_type in ('RUSH', 'STD') and not (invoiced_qty < ordered_qty)) as bigint) as kept, max(ordered_qty -
    invoiced_qty) as most_short, min(invoiced_qty) as least_invoiced, round(avg(ordered_qty), 6) as mean_ordered,
    round(sum(invoiced_qty) / nullif(sum(ordered_qty) - sum(ordered_qty), 0), 6) as undefined_ratio from fact
    group by 1""")
def metric_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Every construct a definition may use, checked before it runs; x / 0 is NULL."""
    custom = m.Metric("probe", 1, "reference",
                      inputs={"kept": "order_type in ('RUSH', 'STD') and not (invoiced_qty < ordered_qty)"},
                      aggregations={"lines": "count(*)", "kept_lines": "sum(kept)",
                                    "most_short": "max(ordered_qty - invoiced_qty)",
                                    "least_invoiced": "min(invoiced_qty)", "mean_ordered": "avg(ordered_qty)",
                                    "undefined_ratio": "sum(invoiced_qty) / (sum(ordered_qty) - sum(ordered_qty))"})
    m.check(spark, custom)
    out = m.aggregate(clean_lines(spark, d), custom, ["plant"]).withColumnRenamed("kept_lines", "kept")
    return round6(out, "mean_ordered", "undefined_ratio")


@query("f10_row_view", ["flags"], """select order_no, line_no, cast(issue_date as varchar) as metric_date, plant,
    customer_no, item_no, product_group, order_type, gov_on_time as on_time, tol_in_full as in_full_count_tolerance,
    tol_in_full as in_full, gov_on_time and tol_in_full as otif from flags""")
def row_view(spark: SparkSession, d: str) -> DataFrame:
    return m.row_view(clean_lines(spark, d), m.BY_VERSION[("otif_case_tolerance", 1)]).withColumn(
        "metric_date", F.col("metric_date").cast("string"))


@query("f14_delivery_derivations", ["flags"], """select order_no, line_no, concat(plant, ' > ', customer_no) as lane,
    gov_on_time::int as on_time, gov_in_full::int as in_full, (gov_on_time and gov_in_full)::int as otif,
    cast(greatest(issue_date - confirmed_delivery_date, 0) as integer) as late_days from flags""")
def derivations(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators.series import delivery_fact

    return delivery_fact(clean_lines(spark, d)).select("order_no", "line_no", "lane", "on_time", "in_full", "otif",
                                                       "late_days")
