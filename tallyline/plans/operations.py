"""Investigation, policy, operating views and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import evaluate as ev
from tallyline.operators import ingest, ops
from tallyline.operators import policy as pol
from tallyline.operators import reconcile as rc
from tallyline.plans import profiling as pp
from tallyline.plans.common import clean_lines
from tallyline.plans.measures import PAIR
from tallyline.plans.quality import _K, found, queue
from tallyline.plans.registry import cte, query
from tallyline.schema import COLUMNS
from tallyline.sources import driver_tables as dt

# ---- operating views -----------------------------------------------------------------------------------------
# The events table stands for the call logs.

CALL_EXPRS = [
    "cast(cast(ts as date) as string) as day", "event_type as purpose", "event_type as tool",
    "concat('provider', cast(user_id % 2 as string)) as provider",
    "case event_id % 10 when 7 then 'invalid_output' when 8 then 'error' when 9 then 'error' when 6 then 'empty' else 'ok' "
    "end as outcome", "case event_id % 10 when 8 then '429 slow down' when 9 then 'timeout' end as error",
    "concat('model', cast(event_id % 3 as string)) as model", "cast(event_id % 1000 as bigint) as input_tokens",
    "cast(case when event_id % 11 <> 0 then event_id * 7 % 400 end as bigint) as output_tokens", "value / 1000e0 as cost_usd",
    "cast(event_id * 37 % 5000 as int) as latency_ms",
    "case event_id % 4 when 0 then 'awaiting_approval' when 1 then 'applied' else 'done' end as status",
    "case user_id % 3 when 0 then 'escalate' when 1 then 'auto_fixable' else 'source_defect' end as run_outcome",
    "case event_id % 6 when 0 then 'auto_apply' when 1 then 'owner_review' when 2 then 'refused' end as gate_disposition",
    "case event_id % 5 when 0 then 'approve' when 1 then 'reject' end as decision", "(event_id % 20 = 3) as fallback",
    "cast(event_id % 7 as int) as iterations", "cast(cast(ts as date) as string) as started_at",
    "cast(cast(ts as date) as string) as called_at",
]
cte("calls", [], f"select {', '.join(CALL_EXPRS)} from events")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return dt.table(spark, d, "events").selectExpr(*CALL_EXPRS)


def runs(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).drop("outcome").withColumnRenamed("run_outcome", "outcome")


TODAY, NOW = "2002-02-01", "2002-02-01 15:36:00"
_HEALTH = """(select source, cast(count(*) as bigint) as batches, cast(count(*) filter (where status = 'validated') as bigint)
    as validated, cast(0 as bigint) as published, cast(count(*) filter (where status = 'blocked') as bigint) as blocked,
    cast(0 as bigint) as failed, cast(count(*) filter (where stale) as bigint) as stale, cast(sum(row_count) as bigint) as
    rows_received, max(received_at) as last_received_at from bts group by 1)"""
_BACK = f"""(select source, rule_id, severity, status, coalesce(owner, '(unassigned)') as owner, cast(count(*) as bigint) as
    exceptions, min(created_on) as oldest_created, round((epoch(timestamp '{NOW}') - epoch(cast(min(created_on) as
    timestamp))) / 86400, 1) as oldest_age_days from queue where status <> 'resolved' group by 1, 2, 3, 4, 5)"""
_USAGE = """(select day, purpose, provider, model, cast(count(*) as bigint) as calls, cast(count(*) filter (where outcome = 'ok') as
    bigint) as ok, cast(count(*) filter (where outcome = 'invalid_output') as bigint) as invalid_output, cast(count(*) filter
    (where outcome = 'error') as bigint) as errors, cast(count(*) filter (where outcome = 'error' and error like '429%') as
    bigint) as rate_limited, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0)
    as bigint) as output_tokens, cast(round(sum(cast(cost_usd as decimal(18,6))), 4)
    as double) as cost_usd, quantile_disc(latency_ms, 0.5) as p50_latency_ms,
    quantile_disc(latency_ms, 0.95) as p95_latency_ms from calls group by 1, 2, 3, 4)"""


@query("a32_pipeline_health", ["bts"], f"select * from {_HEALTH} h")
def health(spark: SparkSession, d: str) -> DataFrame:
    return ops.pipeline_health(dt.batches(spark, d))


@query("a32_exception_backlog", ["queue"], f"select * from {_BACK} b")
def backlog(spark: SparkSession, d: str) -> DataFrame:
    return ops.backlog(queue(spark, d), F.lit(NOW).cast("timestamp"))


@query("t05_backlog_top", ["queue"], f"""select source, rule_id, severity, status, owner, exceptions from {_BACK} b order by
    exceptions desc, source, rule_id, status, severity, owner limit 50""")
def backlog_top(spark: SparkSession, d: str) -> DataFrame:
    return ops.backlog(queue(spark, d), F.lit(NOW).cast("timestamp")).orderBy(
        F.desc("exceptions"), "source", "rule_id", "status", "severity", "owner").limit(50).select(
        "source", "rule_id", "severity", "status", "owner", "exceptions")


@query("a32_agent_runs", ["calls"], """select status, run_outcome as outcome, gate_disposition, decision, cast(count(*) as bigint) as runs,
    cast(count(*) filter (where fallback) as bigint) as fallbacks, round(avg(iterations), 2) as mean_tool_calls, min(case when
    status = 'awaiting_approval' then started_at end) as oldest_awaiting_since from calls group by 1, 2, 3, 4""")
def agent_runs(spark: SparkSession, d: str) -> DataFrame:
    return ops.agent_runs(runs(spark, d))


@query("a32_tool_usage", ["calls"], """select tool, cast(count(*) as bigint) as calls, cast(count(*) filter (where outcome =
    'empty') as bigint) as empty, cast(count(*) filter (where outcome = 'error') as bigint) as errors,
    quantile_disc(latency_ms, 0.5) as p50_latency_ms, quantile_disc(latency_ms, 0.95) as p95_latency_ms, max(called_at) as
    last_called_at from calls group by 1""")
def tool_usage(spark: SparkSession, d: str) -> DataFrame:
    return ops.tool_usage(calls(spark, d))


@query("a33_model_usage", ["calls"], f"select * from {_USAGE} u")
def model_usage(spark: SparkSession, d: str) -> DataFrame:
    return ops.usage(calls(spark, d), ["day", "purpose", "provider", "model"])


@query("a35_batch_status_pivot", ["bts"], """select source, cast(count(*) filter (where status = 'validated') as bigint) as
    validated, cast(count(*) filter (where status = 'blocked') as bigint) as blocked from bts group by 1""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = dt.batches(spark, d).groupBy("source").pivot("status").agg(F.count(F.lit(1)))  # every state there is
    return out.na.fill(0)


@query("a36_batch_results", ["bts", "ol", "queue"], """select b.batch_id, cast(coalesce(o.n, 0) as bigint) as silver_rows,
    cast(coalesce(o.bad, 0) as bigint) as parse_errors, cast(coalesce(q.b, 0) as bigint) as blocking_exceptions,
    cast(coalesce(q.w, 0) as bigint) as warning_exceptions from bts b left join (select batch_id, count(*) as n,
    count(bad_issue) as bad from ol group by 1) o using (batch_id) left join (select batch_id, count(*) filter (where severity
    = 'block') as b, count(*) filter (where severity = 'warn') as w from queue where status <> 'resolved' group by 1) q
    using (batch_id)""")
def batch_results(spark: SparkSession, d: str) -> DataFrame:
    return ingest.batch_results(dt.batches(spark, d), dt.silver(spark, d), queue(spark, d)).select(
        "batch_id", "silver_rows", "parse_errors", "blocking_exceptions", "warning_exceptions")


@query("a38_operator_alerts", ["bts", "queue", "calls", "flags"], PAIR + f""" select concat(source, ': ', blocked,
    ' batch(es) blocked on an unconfirmed mapping') as alert from {_HEALTH} h where blocked > 0 union all select concat(source,
    ': ', stale, ' stale extract(s); publish refuses them') from {_HEALTH} h where stale > 0 union all select
    concat(sum(exceptions), ' blocking exception(s) older than 3 days') from {_BACK} b where severity = 'block' and
    oldest_age_days > 3 having sum(exceptions) > 0 union all select concat(sum(rate_limited),
    ' model call(s) rate limited in the window') from {_USAGE} u having sum(rate_limited) > 0 union all select
    concat(count(*), ' agent run(s) awaiting an owner''s decision') from calls where status = 'awaiting_approval' having
    count(*) > 0 union all select 'latest reconciliation is red: consumer views disagree' from both_pairs having
    count(*) filter (where value_a is null or value_b is null or abs(value_a - value_b) > 1e-9) > 0""")
def operator_alerts(spark: SparkSession, d: str) -> DataFrame:
    compared = rc.compare_consumers(clean_lines(spark, d))
    latest = compared.agg(F.when(F.count_if(F.col("status") == "red") > 0, "red").otherwise("green").alias("status"))
    return ops.alerts(ops.pipeline_health(dt.batches(spark, d)),
                      ops.backlog(queue(spark, d), F.lit(NOW).cast("timestamp")),
                      ops.usage(calls(spark, d), ["day", "purpose", "provider", "model"]), ops.agent_runs(runs(spark, d)), latest)


@query("w08_latest_state", ["bts"], """select source, max_by(batch_id, received_at) as latest_batch, max_by(status,
    received_at) as status, cast(max_by(row_count, received_at) as bigint) as rows from bts group by 1""")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return dt.batches(spark, d).groupBy("source").agg(
        F.max_by(F.struct("batch_id", "status", "row_count"), "received_at").alias("_l")).select(
        "source", F.col("_l.batch_id").alias("latest_batch"), "_l.status", F.col("_l.row_count").alias("rows"))


# ---- investigation -------------------------------------------------------------------------------------------

@query("j15_neighbourhood", [], """with r as (select cast(cast(ts as date) as varchar) as batch_id, event_id as position,
    event_type from events) select t.batch_id, t.position as target_row, r.position, r.event_type, r.position = t.position as
    is_target from r t join r on r.batch_id = t.batch_id and r.position between t.position - 5 and t.position + 5 where
    t.event_type = 'error'""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Log rows around every error of the same day."""
    rows = dt.table(spark, d, "events").select(F.col("ts").cast("date").cast("string").alias("batch_id"),
                                               F.col("event_id").alias("position"), "event_type")
    targets = rows.where("event_type = 'error'").select("batch_id", F.col("position").alias("target_row"))
    return pol.neighbourhood(rows, targets, 5).select("batch_id", "target_row", "position", "event_type", "is_target")


@query("w01_top_lines_per_source", ["ol"], """select customer_no, source, batch_id, source_row, cast(rn as integer) as position
    from (select *, row_number() over (partition by customer_no, source order by batch_id, source_row) as rn from ol where
    customer_no is not null) x where rn <= 5""")
def top_lines(spark: SparkSession, d: str) -> DataFrame:
    return pol.other_sources(dt.order_lines(spark, d), "customer_no", 5).select("customer_no", "source", "batch_id",
                                                                             "source_row", "position")


def facts(spark: SparkSession, d: str) -> DataFrame:
    return pol.exception_facts(queue(spark, d), dt.silver(spark, d), dt.bronze(spark, d),
                               ingest.confirmed_columns(dt.mapping_versions(spark, d)), dt.items(spark, d))


@query("j19_exception_facts", ["queue", "ol", "raw", "its"], """select q.exception_id, q.rule_id, o.uom, r.r_issue_date as
    raw_issue, r.r_ordered_weight_lb as raw_weight, upper(i.uom) as master_uom from queue q join ol o using (batch_id,
    source_row) join raw r using (batch_id, source_row) left join its i on i.item_no = o.item_no""")
def exception_facts(spark: SparkSession, d: str) -> DataFrame:
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return facts(spark, d).select("exception_id", "rule_id", at("row", "uom").alias("uom"),
                                  at("raw", "issue_date").alias("raw_issue"),
                                  at("raw", "ordered_weight_lb").alias("raw_weight"), "master_uom")


@query("j18_fuzzy_master_match")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Customer numbers as plants write them, some with a slip of the pen, against the customer master."""
    c = dt.customers(spark, d)
    n = F.substring("customer_no", 2, 20)
    written = F.when(F.xxhash64("customer_no") % 3 == 0, F.col("customer_no")).when(
        F.xxhash64("customer_no") % 3 == 1, F.concat(F.lit(" cust-"), n)).otherwise(
        F.concat(F.lit("C"), F.substring(n, 1, 3), F.lit("Z"), F.substring(n, 4, 20)))
    return pol.match_master(c.select(written.alias("value")), c.select(F.col("customer_no").alias("key")), True)


# ---- policy --------------------------------------------------------------------------------------------------
# Fixes a careless assistant might propose: right and wrong conversions, re-read dates, forbidden changes.

def proposals(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    k = F.substring_index("exception_id", "|", -1)
    n = F.substring(k, 8, 5).cast("int")
    w = F.try_element_at("row", F.lit("ordered_weight_lb")).cast("double")
    change = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.cast("string").alias("original"),
                                          b.cast("string").alias("proposed"))
    unit = F.try_element_at("row", F.lit("uom"))
    off = F.when(n % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    fix = (F.when(F.col("rule_id") == "V009", F.struct(F.lit("uom_kg_to_lb").alias("kind"), F.array(
        change("ordered_weight_lb", w, w * pol.KG_TO_LB + off), change("uom", unit, F.col("master_uom"))).alias("changes")))
        .when(F.col("rule_id") == "V010", F.struct(F.lit("date_format").alias("kind"), F.array(change(
            "issue_date", F.try_element_at("raw", F.lit("issue_date")), F.lit("2020-01-31"))).alias("changes")))
        .when(F.col("rule_id") == "V002", F.struct(F.lit("date_format").alias("kind"), F.array(change(
            "order_date", F.try_element_at("raw", F.lit("order_date")), F.try_element_at("row", F.lit("order_date"))))
            .alias("changes")))
        .when(F.col("rule_id") == "V004", F.struct(F.lit("rename_customer").alias("kind"), F.array(change(
            "customer_no", F.try_element_at("row", F.lit("customer_no")), F.lit("C000001"))).alias("changes"))))
    return f.select("exception_id", fix["kind"].alias("kind"), (n % 7 != 0).alias("retain_original"),
                    fix["changes"].alias("changes"))


@query("y01_policy_gate", ["queue", "ol"], f"""select q.exception_id, kind, case when kind is null then 'no_fix' when kind =
    'rename_customer' or {_K} % 7 = 0 then 'human_proposal' when rule_id = 'V009' then case when {_K} % 3 = 0 then
    'human_proposal' else 'apply_after_approval' end when rule_id = 'V010' then 'human_proposal' else 'apply_after_approval'
    end as disposition from (select *, case rule_id when 'V009' then 'uom_kg_to_lb' when 'V010' then 'date_format' when 'V002'
    then 'date_format' when 'V004' then 'rename_customer' end as kind from queue) q""")
def policy_gate(spark: SparkSession, d: str) -> DataFrame:
    return pol.judge_changes(proposals(spark, d), facts(spark, d)).select("exception_id", "kind", "disposition")


RESULT_EXPRS = [
    "exception_id", "rule_id", "source", "row_key",
    f"case {_K} % 4 when 0 then 'auto_fixable' when 1 then 'needs_master_data' when 2 then 'source_defect' else 'escalate' "
    "end as outcome",
    f"({_K} % 8 = 0) as has_fix", f"({_K} % 6 = 0) as not_covered",
    "concat(reason, ' ', row_key) as seen", "concat('row:', row_key) as ref1",
    f"case when {_K} % 5 = 0 then 'RES-0001' else rule_id end as ref2",
    f"case when {_K} % 3 = 0 then 'reject' else 'approve' end as decision",
]
cte("results", ["queue"], f"select {', '.join(RESULT_EXPRS)}, status, owner from queue")


def results(spark: SparkSession, d: str) -> DataFrame:
    return queue(spark, d).selectExpr(*RESULT_EXPRS, "status", "owner").withColumn("refs", F.array("ref1", "ref2"))


_OWNER = """case when outcome in ('auto_fixable', 'source_defect') then concat('source:', source) when outcome =
    'needs_master_data' then case rule_id when 'V004' then 'master_data:customers' when 'V005' then 'master_data:items' when
    'V006' then 'master_data:lots' else concat('source:', source) end else case rule_id when 'V003' then 'commercial' when
    'V006' then 'quality' when 'V007' then 'finance' when 'V012' then 'quality' else 'quality' end end"""


@query("y03_owner_routing", ["results"], f"select exception_id, outcome, {_OWNER} as owner from results")
def owner_routing(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("exception_id", "outcome", pol.owner_for(*map(
        F.col, ("outcome", "rule_id", "source"))).alias("owner"))


@query("y04_evidence_check", ["results"], """select exception_id, case when not contains(seen, ref2) then ref2 else '' end as
    problems from results""")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    return pol.evidence_problems(results(spark, d)).select("exception_id", F.array_join("problems", ",").alias("problems"))


@query("y05_classification_consistency", ["results"], """select exception_id, 'only an auto_fixable classification may propose a
    fix' as problem from results where has_fix and outcome <> 'auto_fixable' union all select exception_id, 'an auto_fixable
    classification must say which fix' from results where outcome = 'auto_fixable' and not has_fix union all select
    exception_id, 'not_covered is a source_defect finding' from results where not_covered and outcome <> 'source_defect'
    """.replace("\n    ", " "))
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return pol.consistency_violations(results(spark, d))


@query("y06_apply_decisions", ["results"], f"""select exception_id, case when decision = 'approve' and status <> 'resolved' then
    'assigned' else status end as status, case when decision = 'approve' and status <> 'resolved' then {_OWNER} else owner end
    as owner from results""")
def apply_decisions(spark: SparkSession, d: str) -> DataFrame:
    decisions = results(spark, d).select("exception_id", "outcome", "decision", F.lit("owner").alias("decided_by"))
    return pol.apply_decisions(queue(spark, d), decisions)[0]


# ---- scores against answer keys ------------------------------------------------------------------------------

# What the projection plants for each of the twelve rules: where, and whether the rule can see it there.
FAULTS = {"V001": ("l_orderkey % 97 = 0", "true"), "V002": ("l_partkey % 101 = 0", "bad_issue is null"),
          "V003": ("(l_partkey + l_linenumber) % 173 = 0", "true"),
          "V004": ("l_orderkey % 89 = 0 and l_orderkey % 97 <> 0", "true"), "V005": ("l_partkey % 83 = 0", "true"),
          "V006": ("l_orderkey % 61 = 0 or l_orderkey % 59 = 0", "has_lot"),
          "V007": ("(l_orderkey + l_linenumber) % 211 = 0", "invoiced_qty <> 0"), "V008": ("repeats", "true"),
          "V009": ("kg_fault and l_partkey % 83 <> 0", "true"), "V010": ("(l_orderkey + l_partkey) % 307 = 0", "true"),
          "V011": ("(l_orderkey + l_partkey) % 401 = 0", "invoiced_qty > 0"),
          "V012": ("not has_lot or l_orderkey % 59 = 0", "issue_date is not null")}
_FK = "concat(order_no, '|', cast(line_no as string))"
cte("planted", ["wide"], """select *, row_number() over (partition by batch_id, order_no, line_no order by source_row) > 1 as repeats
    from wide""")
cte("faults", ["planted"], " union all ".join(
    f"select '{r}' as rule, {_FK} as row_key, source, plant, order_year, {seen} as detectable from planted where {cond}"
    for r, (cond, seen) in FAULTS.items()))


def faults(spark: SparkSession, d: str) -> DataFrame:
    """Planted faults by rule and line. Lines sent twice are counted by key, so no window runs over all lines."""
    lines = dt._joined(spark, d).withColumn("repeats", F.lit(False))
    listed = F.filter(F.array(*[F.when(F.expr(cond), F.struct(F.lit(r).alias("rule"), F.expr(seen).alias("detectable")))
                                for r, (cond, seen) in FAULTS.items()]), lambda x: x.isNotNull())
    here = ["source", "plant", "order_year"]
    seen = lines.select(F.expr(_FK).alias("row_key"), *here, F.explode(listed).alias("_f")).select(
        "_f.rule", "row_key", *here, "_f.detectable")
    twice = lines.groupBy("batch_id", *here, "order_no", "line_no").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.lit("V008").alias("rule"), F.expr(_FK).alias("row_key"), *here, F.lit(True).alias("detectable"),
        F.explode(F.sequence(F.lit(2), F.col("_n").cast("int")))).drop("col")
    return seen.unionByName(twice)


def raised(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d, list(FAULTS)).select(F.col("rule_id").alias("rule"), "row_key")


_RAISED = "(select rule_id as rule, row_key from ex)"


@query("e01_exception_recall", ["faults", "ex"], f"""with f as (select rule, row_key, bool_or(detectable) as detectable from
    faults group by 1, 2), r as (select distinct rule, row_key from {_RAISED} x) select *, round_even(case when detectable = 0
    then 1 else caught / cast(detectable as double) end, 4) as recall from (select coalesce(f.rule, r.rule) as rule,
    cast(count(f.rule) as bigint) as seeded, cast(count(*) filter (where f.detectable) as bigint) as detectable,
    cast(count(*) filter (where f.detectable and r.rule is not null) as bigint) as caught, cast(count(r.rule) as bigint) as
    raised from f full join r on f.rule = r.rule and f.row_key = r.row_key group by 1) g""")
def exception_recall(spark: SparkSession, d: str) -> DataFrame:
    return ev.exception_score(faults(spark, d), raised(spark, d))


@query("j22_fault_precision", ["faults", "ex"], f"""with r as (select * from {_RAISED} x) select *, round_even((rows_with_exceptions -
    false_positive_rows) / cast(rows_with_exceptions as double), 4) as row_precision, round_even(matched_pairs /
    cast(exceptions as double), 4) as pair_precision from (select cast(count(*) as bigint) as exceptions, cast(count(distinct
    row_key) as bigint) as rows_with_exceptions, cast(count(distinct case when row_key not in (select row_key from faults)
    then row_key end) as bigint) as false_positive_rows, cast(count(*) filter (where (row_key, rule) in (select (row_key,
    rule) from faults)) as bigint) as matched_pairs from r) g""")
def fault_precision(spark: SparkSession, d: str) -> DataFrame:
    return ev.exception_precision(faults(spark, d), raised(spark, d))


@query("e10_detectability", ["faults"], """select *, round_even(detectable / cast(seeded as double), 4) as ceiling from (select
    rule, cast(count(*) as bigint) as seeded, cast(count(*) filter (where detectable) as bigint) as detectable from faults
    group by 1) g""")
def detectability(spark: SparkSession, d: str) -> DataFrame:
    return ev.detectability(faults(spark, d))


@query("w14_round_robin_sample", ["faults"], """select rule as pattern, plant, row_key, cast(turn as integer) as turn, cast(position
    as integer) as position from (select *, row_number() over (partition by rule order by turn, plant) as position from (select
    *, row_number() over (partition by rule, plant order by row_key) as turn from (select distinct rule, plant, row_key from
    faults) u) a where turn <= 10) b where position <= 10""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    f = faults(spark, d).select(F.col("rule").alias("pattern"), "plant", F.col("row_key").alias("fault_id")).distinct()
    return ev.round_robin(f, 10).withColumnRenamed("fault_id", "row_key")


@query("e08_classification_rates", ["results"], f"""select *, round_even(a / cast(n as double), 4) as accuracy, round_even(l /
    cast(n as double), 4) as lenient_accuracy from (select rule_id as rule, cast(count(*) as bigint) as n, count(*) filter
    (where outcome = 'escalate') as a, count(*) filter (where outcome in ('escalate', 'source_defect')) as l from results where
    ref2 <> 'RES-0001' group by 1) g""".replace("select *, round", "select rule, n, round", 1))
def classification_rates(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select(F.col("rule_id").alias("rule"), F.lit("escalate").alias("expected"), "outcome",
                                 F.array(F.lit("source_defect")).alias("also_ok"), (F.col("ref2") != "RES-0001").alias("valid"))
    return ev.classification_rates(r)


_E12 = f"""(select source, batch_id, source_row, case when dated >= date '{dt.LOT_START}' then 'block' else 'warn' end as
    severity from (select raw.*, o.issue_date as dated from raw join ol o using (batch_id, source_row) where trim(r_lot_no) = ''
    or not raw.has_lot) x where dated is not null)"""
_CR = f"""select source, cast(count(*) filter (where e = 'block') as bigint) as expected_block, cast(count(*) filter (where e =
    'warn') as bigint) as expected_warn, cast(count(*) filter (where r = 'block') as bigint) as raised_block, cast(count(*)
    filter (where r = 'warn') as bigint) as raised_warn, cast(count(*) filter (where r is null) as bigint) as missing,
    cast(count(*) filter (where e is null) as bigint) as unexpected, cast(count(*) filter (where e <> r) as bigint) as
    wrong_severity from (select coalesce(a.source, b.source) as source, a.severity as e, b.severity as r from {_E12} a full
    join (select source, batch_id, source_row, severity from ex where rule_id = 'V012') b on a.batch_id = b.batch_id and
    a.source_row = b.source_row) j group by 1"""


def change_request_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What bronze says should be raised, read without the rule; and what the rule raised."""
    from tallyline.functions.text import strip
    from tallyline.functions.transforms import parse_date

    at = lambda *names: F.coalesce(*[F.try_element_at("record", F.lit(n)) for n in names])
    b = dt.bronze(spark, d).select("source", "batch_id", "source_row", at("lot_no", "LOTID", "Lot").alias("lot"),
                                   at("iss_dt", "DT_SHIP", "ShipDate").alias("issued"))
    day = F.lit(None).cast("date")
    for source, steps in dt.TRANSFORMS_BY_SOURCE.items():
        day = F.when(F.col("source") == source, parse_date(F.col("issued"), steps["date"])).otherwise(day)
    lacking = b.where(F.coalesce(strip(F.col("lot")) == "", F.lit(True))).withColumn("_d", day).where("_d is not null")
    expected = lacking.select("source", "batch_id", "source_row", F.when(
        F.col("_d") >= F.lit(dt.LOT_START).cast("date"), "block").otherwise("warn").alias("severity"))
    return expected, found(spark, d, ["V012"]).select("source", "batch_id", "source_row", "severity")


@query("u05_expected_versus_raised", ["raw", "ol", "ex"], _CR)
def expected_versus_raised(spark: SparkSession, d: str) -> DataFrame:
    return ev.expected_versus_raised(*change_request_sides(spark, d), ["source", "batch_id", "source_row"])


@query("e03_change_request_exactness", ["raw", "ol", "ex"], f"""select source, missing = 0 and unexpected = 0 and wrong_severity =
    0 as exact, expected_block + expected_warn as expected_rows from ({_CR}) c""")
def change_request(spark: SparkSession, d: str) -> DataFrame:
    s = ev.expected_versus_raised(*change_request_sides(spark, d), ["source", "batch_id", "source_row"])
    return s.select("source", ((F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("wrong_severity") == 0))
                    .alias("exact"), (F.col("expected_block") + F.col("expected_warn")).alias("expected_rows"))


@query("e02_drift_score")
def drift_score(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators import drift

    chain = pp.chain(spark, d)
    changes = drift.diff(chain)
    text = pp.alert_messages(spark, d)
    columns = changes.groupBy("source", "batch_id").agg(F.collect_set("column").alias("columns"))
    alerts = text.join(columns, ["source", "batch_id"]).select(
        "source", "message", "columns", F.split("affected_canonical", ",").alias("affected_canonical"), F.concat(
            "source", F.lit("_orderlines_"), F.split("batch_id", ":")[1], F.lit("-01.csv")).alias("file_name"))
    events = spark.createDataFrame([("D1", "plt02", "1998-01", ["customer_no"]), ("D2", "plt01", "1999-01", ["lot_no"])],
                                   "drift_id string, source string, month string, affected array<string>")
    return ev.drift_score(events, alerts)


@query("e04_mapping_accuracy")
def mapping_accuracy(spark: SparkSession, d: str) -> DataFrame:
    truth = spark.createDataFrame(sorted({(s, h, c) for s, _, _, header in dt.HEADERS for h, c in zip(header, COLUMNS)}),
                                  "source string, source_col string, want string")
    return ev.mapping_score(pp.proposals(spark, d), truth)


@query("e05_reconciliation_score", ["flags", "feed2"], """with m as (select f.*, abs(e.r - f.g) as gap, round_even(f.t2 - f.g, 5) as
    tg from (select month, avg((gov_on_time and gov_in_full)::int) as g, count(*) filter (where req_on_time and tol_in_full and
    order_type <> 'CONS') / nullif(cast(count(*) filter (where order_type <> 'CONS') as double), 0) as t2 from flags group by 1)
    f left join (select month, sum(otif_lines) / cast(sum(lines) as double) as r from feed2 group by 1) e using (month))
    select cast(count(*) as bigint) as months, cast(count(*) filter (where gap > 0.001 and abs(tg) > 0.001) as bigint) as
    gaps_flagged, cast(count(*) filter (where abs(tg) > 0.001) as bigint) as gaps_expected, cast(0 as double) as worst_error,
    true as within_tolerance from m""")
def reconciliation_score(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators import feeds
    from tallyline.plans.measures import attributed_monthly

    truth = feeds.gap_truth(clean_lines(spark, d)).select(
        F.col("month").alias("period"), F.col("tool2_gap").alias("true_gap"), "weight_basis", "date_basis", "case_tolerance")
    # greatest() skips NULL, so a missing contribution is made infinitely wrong first
    error = F.greatest(*[F.coalesce(F.abs(F.try_element_at("contributions", F.lit(c)) - F.col(c)), F.lit(float("inf")))
                         for c in ("weight_basis", "date_basis", "case_tolerance")])
    return ev.reconciliation_score(attributed_monthly(spark, d), truth, error)
