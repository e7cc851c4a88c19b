"""Validation: row transforms, the rules, the exception queue and its workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import transforms as tf
from tallyline.functions.joins import insert_if_absent, keep_first
from tallyline.operators import exceptions as ex
from tallyline.operators import rules
from tallyline.plans.registry import cte, query
from tallyline.sources import driver_tables as dt

V_COLUMNS = ["batch_id", "source_row", "row_key", "severity", "owner", "reason", "suggested_fix"]


def masters(spark: SparkSession, d: str) -> rules.Masters:
    return rules.Masters(dt.customers(spark, d), dt.items(spark, d), dt.lots(spark, d))


def found(spark: SparkSession, d: str, wanted: list[str] = rules.RULES) -> DataFrame:
    return rules.violations(dt.silver(spark, d), masters(spark, d), dt.dictionary(), wanted)


# Workflow state of an exception on these tables, by arithmetic on the order number.
_K = "cast(substr(source_row, 8, 5) as int)"
QUEUE_EXPRS = [
    "concat(batch_id, '|', rule_id, '|', source_row) as exception_id",
    f"case when {_K} % 11 = 0 or {_K} % 13 = 0 then 'resolved' when {_K} % 17 = 0 then 'assigned' else 'open' end "
    "as status",
    f"case when {_K} % 11 = 0 then 'accept' when {_K} % 13 = 0 then 'exclude' end as resolution_kind",
    f"case when {_K} % 11 = 0 or {_K} % 13 = 0 then 'data_owner' end as resolved_by",
    f"concat('2002-01-', lpad(cast(1 + {_K} % 28 as string), 2, '0')) as created_on",
]


def queue(spark: SparkSession, d: str) -> DataFrame:
    """The exceptions with their workflow state. What all rules found is a stored table, as the queue is in operation."""
    return dt.stored(spark, d, "exceptions", lambda: found(spark, d).drop("details")).selectExpr("*", *QUEUE_EXPRS)


def details_text(column: str = "details"):
    pairs = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(pairs, lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), ";")


# ---- the rules as SQL ----------------------------------------------------------------------------------------

def _t(x: str) -> str:
    return f"coalesce(cast({x} as varchar), 'None')"


_KEYTXT = "concat(coalesce(order_no, '?'), '|', coalesce(cast(line_no as varchar), '?')) as row_key"
_HEAD = f"batch_id, source, source_row, {_KEYTXT}"


def _rule_sql(rule: str, where: str, details: str, reason: str | None = None, fix: str | None = None,
              severity: str | None = None, owner: str | None = None, frm: str = "ol") -> str:
    sev, who, message, advice = rules.CATALOG[rule]
    own = owner or (f"'{who}'" if who else "concat('source:', source)")
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    return (f"select {_HEAD}, '{rule}' as rule_id, {severity or lit(sev)} as severity, {own} as owner, "
            f"{reason or lit(message)} as reason, {fix or lit(advice)} as suggested_fix, {details} as details "
            f"from {frm} where {where}")


_MISSING = " , ".join(
    f"case when {c} is null{' and bad_issue is null' if c == 'issue_date' else ''} then '{c}' end"
    for c in ["order_no", "line_no", "customer_no", "item_no", "plant", "order_date", "requested_date",
              "confirmed_delivery_date", "issue_date", "ordered_qty"])
_LACK12 = "(case when has_lot then lot_no is null else true end)"
_HOW12 = "case when has_lot then 'blank' else 'not in this source''s extract' end"
_D12 = dt.dictionary().dated[0]
_RATIO = "ordered_weight_lb / nullif(ordered_qty * avg_lb_per_case, 0)"
_LIKELY = f"case when {_RATIO} > 0.35 and {_RATIO} < 0.6 then 'kg' else 'an unknown unit' end"
cte("ex", ["ol", "custs", "its", "lts"], " union all ".join([
    _rule_sql("V001", "len(missing) > 0", "concat('missing=', array_to_string(missing, ','))",
              "concat('Required field(s) blank: [', array_to_string(list_transform(missing, lambda x: concat('''', x, "
              "'''')), ', '), ']')",
              frm=f"(select *, list_filter([{_MISSING}], lambda x: x is not null) as missing from ol) m"),
    _rule_sql("V002", "issue_date < order_date or confirmed_delivery_date < requested_date - 30",
              f"concat('confirmed_delivery_date=', {_t('confirmed_delivery_date')}, ';issue_date=', "
              f"{_t('issue_date')}, ';order_date=', {_t('order_date')}, ';requested_date=', "
              f"{_t('requested_date')})"),
    _rule_sql("V003", "invoiced_weight_lb < 0 or invoiced_weight_lb > ordered_weight_lb * cast(1.05 as double)",
              f"concat('invoiced_weight_lb=', {_t('invoiced_weight_lb')}, ';ordered_weight_lb=', "
              f"{_t('ordered_weight_lb')})"),
    _rule_sql("V004", "customer_no is not null and not exists (select 1 from custs c where c.customer_no = "
              "ol.customer_no)", f"concat('customer_no=', {_t('customer_no')})",
              "concat('Customer ', customer_no, ' is not in the customer master')"),
    _rule_sql("V005", "item_no is not null and not exists (select 1 from its i where i.item_no = ol.item_no)",
              f"concat('item_no=', {_t('item_no')})", "concat('Item ', item_no, ' is not in the item master')"),
    _rule_sql("V006", "problem is not null",
              f"concat('expiry_date=', {_t('expiry_date')}, ';issue_date=', {_t('issue_date')}, ';lot_no=', "
              f"{_t('lot_no')}, ';problem=', problem)",
              f"concat('Lot ', {_t('lot_no')}, ': ', problem)",
              frm="(select ol.*, l.expiry_date, case when not has_lot then null when ol.lot_no is null then "
                  "'lot number blank' when l.lot_no is null then 'lot not in the lot master' when issue_date > "
                  "l.expiry_date then 'shipped after expiry' end as problem from ol left join lts l on "
                  "ol.lot_no = l.lot_no) x"),
    _rule_sql("V007", "ordered_qty < 0 or invoiced_qty < 0",
              f"concat('invoiced_qty=', {_t('invoiced_qty')}, ';ordered_qty=', {_t('ordered_qty')})"),
    _rule_sql("V008", "source_row > first_row",
              "concat('first_row=', first_row, ';line_no=', line_no, ';order_no=', order_no)",
              "concat('Order line ', order_no, '|', line_no, ' already appears in this batch at row ', first_row)",
              frm="(select *, min(source_row) over (partition by batch_id, order_no, line_no) as first_row "
                  "from ol) x"),
    _rule_sql("V009", "upper(trim(x_uom)) <> m_uom",
              f"concat('item_no=', item_no, ';likely_unit=', {_LIKELY}, ';master_uom=', m_uom, ';uom=', x_uom, "
              f"';weight_to_expected_lb_ratio=', {_t(f'cast(round_even({_RATIO}, 3) as double)')})",
              "concat('UOM ', x_uom, ' differs from item master basis ', m_uom)",
              f"concat('Weights look recorded in ', {_LIKELY}, ': convert to lb and set UOM to ', m_uom, "
              "', keeping the original')",
              frm="(select ol.*, ol.uom as x_uom, upper(i.uom) as m_uom, i.avg_lb_per_case from ol join its i "
                  "on ol.item_no = i.item_no) x"),
    _rule_sql("V010", "bad_issue is not null", "concat('issue_date=', bad_issue)",
              "concat('Value(s) did not parse: {''issue_date'': ''', bad_issue, '''}')"),
    _rule_sql("V011", "invoiced_qty > 0 and ordered_qty <= 0",
              f"concat('invoiced_qty=', {_t('invoiced_qty')}, ';ordered_qty=', {_t('ordered_qty')})"),
    _rule_sql("V012", f"{_LACK12} and issue_date is not null",
              f"concat('by=issue_date;column=lot_no;coverage=', case when blk then 'required' else 'not_covered' "
              f"end, ';dictionary_version=2;in_extract=', cast(has_lot as varchar), ';issue_date=', "
              f"{_t('issue_date')}, ';required_from={dt.LOT_START}')",
              f"case when blk then concat('lot_no required from {dt.LOT_START} (field dictionary v2) is ', "
              f"{_HOW12}) else concat('lot_no not covered before {dt.LOT_START}: ', {_HOW12}) end",
              f"case when blk then '{_D12.fix}' else '{_D12.before}' end",
              "case when blk then 'block' else 'warn' end", "'quality'",
              frm=f"(select *, issue_date >= date '{dt.LOT_START}' as blk from ol) x"),
]))
cte("queue", ["ex"], f"select *, {', '.join(QUEUE_EXPRS)} from ex")

# ---- rules and coverage --------------------------------------------------------------------------------------

_NAMES = {"V001": "required_fields", "V002": "date_order", "V003": "weight_tolerance", "V004": "known_customer",
          "V005": "known_item", "V006": "lot_not_expired", "V007": "non_negative_qty", "V008": "duplicate_line",
          "V009": "uom_matches_master", "V010": "values_parsed", "V011": "ordered_when_invoiced",
          "V012": "required_from_date"}


def _register_rule(rule: str, name: str) -> None:
    @query(f"{rule.lower()}_{name}", ["ex"],
           f"select {', '.join(V_COLUMNS)}, details from ex where rule_id = '{rule}'")
    def one_rule(spark: SparkSession, d: str) -> DataFrame:
        return found(spark, d, [rule]).select(*V_COLUMNS, details_text().alias("details"))


for _rule, _name in _NAMES.items():
    _register_rule(_rule, _name)


@query("vx1_all_rules", ["ex"], "select batch_id, source, source_row, row_key, rule_id, severity, owner, reason, "
                                "suggested_fix, details from ex")
def all_rules(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("batch_id", "source", "source_row", "row_key", "rule_id", "severity", "owner",
                                  "reason", "suggested_fix", details_text().alias("details"))


@query("vx3_coverage", ["ex", "ol"], """
    select b.batch_id, b.rows_validated, r.rule_id, cast(count(ex.rule_id) as bigint) as violations
    from (select batch_id, count(*) as rows_validated from ol group by 1) b
    cross join (select unnest(['V001','V002','V003','V004','V005','V006','V007','V008','V009','V010','V011','V012'])
                as rule_id) r
    left join ex on ex.batch_id = b.batch_id and ex.rule_id = r.rule_id group by 1, 2, 3""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return rules.coverage(dt.silver(spark, d), found(spark, d))


@query("j01_unknown_keys", ["ol", "custs", "its"], """
    select 'customer' as master, customer_no as key_value, cast(count(*) as bigint) as n from ol where customer_no is
    not null and customer_no not in (select customer_no from custs) group by 2
    union all select 'item', item_no, cast(count(*) as bigint) from ol where item_no is not null and item_no not in
    (select item_no from its) group by 2""")
def unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    lines = dt.order_lines(spark, d)
    out = []
    for label, key, master in (("customer", "customer_no", dt.customers(spark, d)),
                               ("item", "item_no", dt.items(spark, d))):
        # count each key first: the anti join then sees one row per key
        counted = lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        out.append(counted.join(master.select(key), key, "left_anti")
                   .select(F.lit(label).alias("master"), F.col(key).alias("key_value"), "n"))
    return out[0].unionByName(out[1])


@query("j02_lot_lookup", ["ol", "lts"], """
    select problem, cast(count(*) as bigint) as lines, cast(count(distinct x.lot_no) as bigint) as lots from (
      select ol.lot_no, case when not has_lot then 'not checked' when ol.lot_no is null then 'lot number blank'
        when l.lot_no is null then 'lot not in the lot master' when issue_date > l.expiry_date then
        'shipped after expiry' else 'ok' end as problem
      from ol left join lts l on ol.lot_no = l.lot_no) x group by 1""")
def lot_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = rules.enrich(dt.silver(spark, d), masters(spark, d), ["V006"])
    problem = (F.when(~F.array_contains("mapped", "lot_no"), "not checked")
               .when(F.col("lot_no").isNull(), "lot number blank")
               .when(F.col("_expiry").isNull(), "lot not in the lot master")
               .when(F.col("issue_date") > F.col("_expiry"), "shipped after expiry").otherwise("ok"))
    return (lines.groupBy(problem.alias("problem"))
            .agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("lot_no").alias("lots")))


@query("j03_item_uom_lookup", ["ol", "its"], """
    select item_no, uom, master_uom, cast(count(*) as bigint) as lines, round(min(ratio), 6) as min_ratio,
      round(max(ratio), 6) as max_ratio from (
      select ol.item_no, ol.uom, upper(i.uom) as master_uom,
        ordered_weight_lb / nullif(ordered_qty * avg_lb_per_case, 0) as ratio
      from ol join its i on ol.item_no = i.item_no where ol.uom <> upper(i.uom)) x group by 1, 2, 3""")
def item_uom_lookup(spark: SparkSession, d: str) -> DataFrame:
    lines = rules.enrich(dt.silver(spark, d), masters(spark, d), ["V009"])
    ratio = F.try_divide("ordered_weight_lb", F.col("ordered_qty") * F.col("_lb"))
    return (lines.where(F.col("uom") != F.col("_master_uom"))
            .groupBy("item_no", "uom", F.col("_master_uom").alias("master_uom"))
            .agg(F.count(F.lit(1)).alias("lines"), F.round(F.min(ratio), 6).alias("min_ratio"),
                 F.round(F.max(ratio), 6).alias("max_ratio")))


@query("w02_repeats_in_batch", ["ol"], """
    select batch_id, order_no, line_no, source_row, first_row from (select *, min(source_row) over (partition by
    batch_id, order_no, line_no) as first_row from ol) x where source_row > first_row""")
def repeats(spark: SparkSession, d: str) -> DataFrame:
    lines = dt.order_lines(spark, d)
    return (lines.join(rules.repeated_keys(lines), ["batch_id", "order_no", "line_no"])
            .where("source_row > first_row")
            .select("batch_id", "order_no", "line_no", "source_row", "first_row"))


@query("w03_keep_first", ["ol"], """
    select batch_id, order_no, line_no, source_row, ordered_qty, invoiced_qty from (select *, row_number() over
    (partition by batch_id, order_no, line_no order by source_row) as rn from ol) x where rn = 1""")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    lines = dt.order_lines(spark, d).select("batch_id", "order_no", "line_no", "source_row", "ordered_qty",
                                            "invoiced_qty")
    return keep_first(lines, ["batch_id", "order_no", "line_no"], ["source_row"])


# ---- keeping the queue in step -------------------------------------------------------------------------------
# The second run differs from the first: corrected masters now know the items that were unknown, and one more
# rule outcome appears because the queue starts without V011.

_OLD = "select * from queue where rule_id <> 'V011'"
_NEW = "select * from ex where rule_id <> 'V005'"
_SYNC = f"""select coalesce(o.batch_id, n.batch_id) as batch_id, coalesce(o.rule_id, n.rule_id) as rule_id,
  coalesce(o.source_row, n.source_row) as source_row,
  case when o.rule_id is null then 'open' when n.rule_id is null and o.status <> 'resolved' then 'resolved'
       else o.status end as status,
  case when o.rule_id is not null and n.rule_id is null and o.status <> 'resolved' then 'no_longer_violated'
       else o.resolution_kind end as resolution_kind,
  case when o.rule_id is not null and n.rule_id is null and o.status <> 'resolved' then 'system:revalidation'
       else o.resolved_by end as resolved_by,
  case when o.rule_id is null then 'raised' when n.rule_id is null and o.status <> 'resolved' then 'auto_resolved'
       else 'kept' end as change
  from ({_OLD}) o full join ({_NEW}) n on o.batch_id = n.batch_id and o.rule_id = n.rule_id
  and o.source_row = n.source_row"""


def _synced(spark: SparkSession, d: str) -> DataFrame:
    return ex.sync(queue(spark, d).where("rule_id <> 'V011'"), found(spark, d).where("rule_id <> 'V005'"))


@query("vx2_queue_in_step", ["queue", "ex"], _SYNC)
def queue_in_step(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d).select("batch_id", "rule_id", "source_row", "status", "resolution_kind", "resolved_by",
                                    "change")


@query("vx6_revalidation_report", ["queue", "ex"], f"""select batch_id, rule_id,
    cast(count(*) filter (where change <> 'auto_resolved') as bigint) as violations,
    cast(count(*) filter (where status <> 'resolved') as bigint) as open_exceptions,
    cast(count(*) filter (where change = 'auto_resolved') as bigint) as auto_resolved
    from ({_SYNC}) s group by 1, 2""")
def revalidation_report(spark: SparkSession, d: str) -> DataFrame:
    return ex.revalidation_report(_synced(spark, d))


@query("j11_no_longer_violated", ["queue", "ex"], f"""select o.exception_id from ({_OLD}) o where o.status <>
    'resolved' and not exists (select 1 from ({_NEW}) n where n.batch_id = o.batch_id and n.rule_id = o.rule_id and
    n.source_row = o.source_row)""")
def no_longer_violated(spark: SparkSession, d: str) -> DataFrame:
    live = queue(spark, d).where("rule_id <> 'V011' and status <> 'resolved'")
    now = found(spark, d).where("rule_id <> 'V005'").select(*ex.KEY)
    return live.join(now, ex.KEY, "left_anti").select("exception_id")


@query("j12_insert_if_absent", ["queue", "ex"], f"""select rule_id, cast(count(*) as bigint) as n from (
    select batch_id, rule_id, source_row from ({_OLD}) o union select batch_id, rule_id, source_row from ex) u
    group by 1""")
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    existing = queue(spark, d).where("rule_id <> 'V011'").select(*ex.KEY)
    merged = insert_if_absent(existing, found(spark, d).select(*ex.KEY), ex.KEY)
    return merged.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# ---- workflow ------------------------------------------------------------------------------------------------
# Three events per exception: an assignment, a resolution (too short a reason for some), a late assignment.

EVENT_EXPRS = [
    "exception_id", "step as event_id", "case step when 2 then 'resolved' else 'assigned' end as action",
    "concat('user', cast(step as string)) as actor",
    "case step when 1 then 'team_a' when 3 then 'team_b' end as new_owner",
    f"case when step = 2 then case when {_K} % 3 = 0 then 'accept' else 'fixed_at_source' end end as kind",
    f"case when step = 2 then case when {_K} % 5 = 0 then 'short' else 'checked with the plant' end end as reason_text",
]
cte("events_log", ["queue"], f"select {', '.join(EVENT_EXPRS)} from queue cross join (select unnest([1,2,3]) as step) s")


def workflow_events(spark: SparkSession, d: str) -> DataFrame:
    return (queue(spark, d).withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
            .selectExpr(*EVENT_EXPRS).withColumnsRenamed({"new_owner": "owner", "reason_text": "reason"}))


@query("vx5_workflow_state", ["queue", "events_log"], """
    with res as (select exception_id, min(event_id) as at, min_by(kind, event_id) as kind, min_by(actor, event_id) as
      actor from events_log where action = 'resolved' and kind in ('accept', 'exclude', 'fixed_at_source')
      and length(reason_text) >= 10 group by 1),
    asg as (select e.exception_id, max_by(new_owner, event_id) as owner from events_log e join queue q using
      (exception_id) left join res r using (exception_id) where action = 'assigned' and q.status <> 'resolved' and
      (r.at is null or e.event_id <= r.at) group by 1)
    select q.exception_id, case when q.status = 'resolved' or r.at is not null then 'resolved' when a.owner is not null
      then 'assigned' else q.status end as status, coalesce(a.owner, q.owner) as owner,
      coalesce(case when q.status <> 'resolved' then r.kind end, q.resolution_kind) as resolution_kind,
      coalesce(case when q.status <> 'resolved' then r.actor end, q.resolved_by) as resolved_by
    from queue q left join res r using (exception_id) left join asg a using (exception_id)""")
def workflow_state(spark: SparkSession, d: str) -> DataFrame:
    state, _ = ex.fold(queue(spark, d), workflow_events(spark, d))
    return state.select("exception_id", "status", "owner", "resolution_kind", "resolved_by")


@query("vx5_refused_transitions", ["queue", "events_log"], """
    with res as (select exception_id, min(event_id) as at from events_log where action = 'resolved' and length(
      reason_text) >= 10 group by 1)
    select e.exception_id, event_id, action, case when q.status = 'resolved' or event_id > r.at then 'already resolved'
      else 'invalid resolution' end as refused
    from events_log e join queue q using (exception_id) left join res r using (exception_id)
    where q.status = 'resolved' or event_id > r.at or (action = 'resolved' and length(reason_text) < 10)""")
def refused_transitions(spark: SparkSession, d: str) -> DataFrame:
    _, refused = ex.fold(queue(spark, d), workflow_events(spark, d))
    return refused.select("exception_id", "event_id", "action", "refused")


@query("f06_exception_page", ["queue"], """select p.*, (select cast(count(*) as bigint) from queue where source = 'plt02' and severity
    = 'block') as total from (select exception_id, severity, status, rule_id, owner from queue where source = 'plt02' and severity =
    'block' order by severity, status, rule_id, exception_id limit 50 offset 100) p""")
def exception_page(spark: SparkSession, d: str) -> DataFrame:
    return ex.page(queue(spark, d), {"source": "plt02", "severity": "block"}, limit=50, offset=100) \
        .select("exception_id", "severity", "status", "rule_id", "owner", "total")


@query("a24_exception_summary", ["queue"], """
    select 'by_status' as facet, status as value, cast(count(*) as bigint) as n from queue group by 2
    union all select 'open_by_rule', rule_id, cast(count(*) as bigint) from queue where status <> 'resolved' group by 2
    union all select 'open_by_owner', coalesce(owner, '-'), cast(count(*) as bigint) from queue where status <>
      'resolved' group by 2
    union all select 'open_blocking', 'all', cast(count(*) as bigint) from queue where status <> 'resolved' and
      severity = 'block'""")
def exception_summary(spark: SparkSession, d: str) -> DataFrame:
    return ex.summary(queue(spark, d))


@query("f12_exception_detail", ["queue", "events_log", "raw", "ol"], """
    select q.exception_id, r.r_issue_date as raw_issue, cast(o.issue_date as varchar) as issue_date, o.ordered_qty,
      h.history from queue q join raw r using (batch_id, source_row) join ol o using (batch_id, source_row)
    join (select exception_id, string_agg(concat(cast(event_id as varchar), ':', action), ',' order by event_id) as
      history from events_log group by 1) h using (exception_id)""")
def exception_detail(spark: SparkSession, d: str) -> DataFrame:
    q = queue(spark, d).select("exception_id", "batch_id", "source_row")
    bronze = dt.bronze(spark, d).select("batch_id", "source_row", "record")
    silver = dt.silver(spark, d).select("batch_id", "source_row", "issue_date", "ordered_qty")
    out = ex.detail(q, bronze, silver, workflow_events(spark, d))
    raw = F.coalesce(*[F.try_element_at("record", F.lit(c)) for c in ("iss_dt", "DT_SHIP", "ShipDate")])
    return out.select("exception_id", raw.alias("raw_issue"), F.col("issue_date").cast("string").alias("issue_date"),
                      "ordered_qty", F.array_join(F.transform("events", lambda e: F.concat(
                          e["event_id"].cast("string"), F.lit(":"), e["action"])), ",").alias("history"))


# ---- row transforms ------------------------------------------------------------------------------------------

def _transform_query(name: str, source: str, raw: str, canonical: str, steps: list[str], sql_value: str,
                     out_cast: str = "string") -> None:
    duck = {"string": "varchar", "double": "double", "int": "integer"}[out_cast]

    @query(name, ["raw"], f"""select source_row, {raw} as raw_text, cast(val as {duck}) as value,
        (val is null and trim({raw}) <> '') as bad from (select *, case when trim({raw}) <> '' then {sql_value} end as
        val from raw where source = '{source}') x""")
    def transform(spark: SparkSession, d: str) -> DataFrame:
        value = tf.typed(F.col(raw), canonical, steps)
        lines = dt.raw_lines(spark, d).where(F.col("source") == source)
        return lines.select("source_row", F.col(raw).alias("raw_text"), value.cast(out_cast).alias("value"),
                            tf.parse_error(F.col(raw), value).isNotNull().alias("bad"))


_transform_query("c01_trim", "plt03", "r_item_no", "item_no", ["trim"], "trim(r_item_no)")
_transform_query("c02_parse_date_iso", "plt01", "r_issue_date", "issue_date", ["parse_date_iso"],
                 "cast(try_strptime(r_issue_date, '%Y-%m-%d') as date)")
_transform_query("c03_parse_date_us", "plt02", "r_issue_date", "issue_date", ["parse_date_us"],
                 "cast(try_strptime(r_issue_date, '%m/%d/%Y') as date)")
_transform_query("c04_parse_date_dmy", "plt02", "r_order_date", "order_date", ["parse_date_dmy"],
                 "cast(try_strptime(r_order_date, '%d/%m/%Y') as date)")
_transform_query("c05_parse_excel_serial", "plt03", "r_issue_date", "issue_date", ["parse_excel_serial"],
                 "cast(date '1899-12-30' + try_cast(r_issue_date as integer) as date)")
_transform_query("c06_kg_to_lb", "plt02", "r_ordered_weight_lb", "ordered_weight_lb", ["kg_to_lb"],
                 "try_cast(r_ordered_weight_lb as double) * cast(2.2046226218 as double)", "double")
_transform_query("c07_normalize_customer_no", "plt03", "r_customer_no", "customer_no", ["normalize_customer_no"],
                 "concat('C', case when length(ltrim(regexp_replace(r_customer_no, '\\D', '', 'g'), '0')) >= 6 then "
                 "ltrim(regexp_replace(r_customer_no, '\\D', '', 'g'), '0') else lpad(ltrim(regexp_replace("
                 "r_customer_no, '\\D', '', 'g'), '0'), 6, '0') end)")
_transform_query("c08_line_number", "plt01", "r_line_no", "line_no", [], "try_cast(r_line_no as integer)", "int")


def _transform_all_query(name: str, raw: str, canonical: str, steps: list[str], sql_value: str, out_cast: str) -> None:
    """A transform that no plant has of its own, over the lines of all plants."""
    duck = {"string": "varchar", "int": "integer"}[out_cast]

    @query(name, ["raw"], f"""select batch_id, source_row, {raw} as raw_text, cast(val as {duck}) as value,
        (val is null and trim({raw}) <> '') as bad from (select *, case when trim({raw}) <> '' then {sql_value} end as
        val from raw) x""")
    def transform(spark: SparkSession, d: str) -> DataFrame:
        value = tf.typed(F.col(raw), canonical, steps)
        return dt.raw_lines(spark, d).select("batch_id", "source_row", F.col(raw).alias("raw_text"), value.cast(
            out_cast).alias("value"), tf.parse_error(F.col(raw), value).isNotNull().alias("bad"))


_transform_all_query("c10_trim_all", "r_item_no", "item_no", ["trim"], "trim(r_item_no)", "string")
_transform_all_query("c11_line_number_all", "r_line_no", "line_no", [], "try_cast(r_line_no as integer)", "int")


@query("c09_blank_or_error", ["raw"], """
    select source, cast(count(*) filter (where trim(r_issue_date) = '') as bigint) as blank_issue,
      cast(count(*) filter (where r_issue_date like '31/31%') as bigint) as bad_issue,
      cast(count(*) filter (where trim(r_ordered_weight_lb) = '') as bigint) as blank_weight,
      cast(0 as bigint) as bad_weight from raw group by 1""")
def blank_or_error(spark: SparkSession, d: str) -> DataFrame:
    lines = dt.raw_lines(spark, d)
    parser = F.lit(None).cast("date")
    for source, steps in dt.TRANSFORMS_BY_SOURCE.items():
        parser = F.when(F.col("source") == source, tf.parse_date(F.col("r_issue_date"), steps["date"])) \
            .otherwise(parser)
    weight = tf.number(F.col("r_ordered_weight_lb"))
    return lines.groupBy("source").agg(
        F.count_if(F.trim("r_issue_date") == "").alias("blank_issue"),
        F.count_if(tf.parse_error(F.col("r_issue_date"), parser).isNotNull()).alias("bad_issue"),
        F.count_if(F.trim("r_ordered_weight_lb") == "").alias("blank_weight"),
        F.count_if(tf.parse_error(F.col("r_ordered_weight_lb"), weight).isNotNull()).alias("bad_weight"))
