"""Daily series, backlog, yields, stock ageing and anomalies."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import series as s
from tallyline.plans.common import clean_lines, round6
from tallyline.plans.registry import cte, query
from tallyline.sources import driver_tables as dt

# Labels on these tables: holidays of each year, and windows with what they should show.
HOLIDAYS = [date(y, m, d) for y in range(1995, 2003) for m, d in ((1, 1), (7, 4), (12, 25))]
WINDOWS = [(1, "A1", "1997-03-01", "1997-03-21", "down", 0.01), (2, "A2", "1998-06-10", "1998-06-30", "up", 0.01),
           (3, "A5", "1998-12-20", "1999-01-05", "down", 0.05), (4, "A6", "1998-12-28", "1999-02-10", "up", 20.0)]


def facts(spark: SparkSession, d: str) -> DataFrame:
    return s.delivery_fact(clean_lines(spark, d))


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "position int, anomaly_id string, start string, end string, "
                                          "direction string, min_abs double").withColumns(
        {c: F.col(c).cast("date") for c in ("start", "end")})


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("metric_date", F.col("metric_date").cast("string"))


cte("wins", [], "select position, anomaly_id, cast(s as date) as start_day, cast(e as date) as end_day, direction, "
    "cast(min_abs as double) as min_abs from (values " + ", ".join(str(w) for w in WINDOWS) + ") t(position, anomaly_id, s, e, direction, min_abs)")
cte("hol", [], "select distinct cast(h + k as date) as day from (select unnest([" + ", ".join(
    f"date '{h}'" for h in HOLIDAYS) + "]) as h) a cross join (select unnest([-2, -1, 0, 1, 2]) as k) b")
_COLS = """cast(count(*) as bigint) as lines, avg((gov_on_time and gov_in_full)::int) as otif_rate,
    avg(gov_on_time::int) as on_time_rate, sum(invoiced_qty) / nullif(sum(ordered_qty), 0) as fill_rate_count,
    sum(invoiced_weight_lb) / nullif(sum(ordered_weight_lb), 0) as fill_rate_weight,
    round(sum(ordered_weight_lb), 4) as ordered_weight_lb"""
for _name, _keys in s.GRAINS.items():
    cte(f"daily_{_name}", ["flags"],
        f"select {', '.join(['issue_date as metric_date', *_keys])}, {_COLS} from flags group by all")
_R = ["otif_rate", "on_time_rate", "fill_rate_count", "fill_rate_weight"]
# a ratio of summed weights may sit exactly between two roundings; the nudge takes both sides off that edge
_SHOW = ", ".join(f"round({c} + cast(1e-9 as double), 6) as {c}" for c in _R)


def _segment_sql(keys: list[str]) -> str:
    return f"concat_ws('|', {', '.join(f'coalesce({k}, chr(0))' for k in keys)})".replace("chr(0)", "''") \
        if keys else "''"


@query("a26_daily_series", [f"daily_{g}" for g in s.GRAINS], " union all ".join(
    f"select '{g}' as grain, {_segment_sql(keys)} as segment, cast(metric_date as varchar) as metric_date, lines, "
    f"{_SHOW}, ordered_weight_lb from daily_{g}" for g, keys in s.GRAINS.items()))
def daily(spark: SparkSession, d: str) -> DataFrame:
    base, out = s.daily_base(facts(spark, d)), None
    for name, keys in s.GRAINS.items():
        segment = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in keys]) if keys else F.lit("")
        part = s.daily_series(base, keys).withColumn("grain", F.lit(name)).withColumn("segment", segment).drop(*keys)
        out = part if out is None else out.unionByName(part)
    nudged = out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in _R})
    return _day(nudged.withColumn("ordered_weight_lb", F.round("ordered_weight_lb", 4)))


_BACKLOG = """select cast(dd.day as varchar) as metric_date, p.plant, cast(count(f.order_no) as bigint) as
    open_backlog_lines from (select distinct issue_date as day from flags) dd cross join (select distinct plant from
    flags) p left join flags f on f.plant = p.plant and f.order_date <= dd.day and f.issue_date > dd.day group by 1, 2"""


@query("j20_backlog_as_at", ["flags"], _BACKLOG)
def backlog(spark: SparkSession, d: str) -> DataFrame:
    return _day(s.backlog(facts(spark, d)))


@query("w12_running_backlog", ["flags"], f"""select plant, substr(metric_date, 1, 7) as month, max(open_backlog_lines)
    as peak, min(open_backlog_lines) as trough from ({_BACKLOG}) b group by 1, 2""")
def running_backlog(spark: SparkSession, d: str) -> DataFrame:
    b = s.backlog(facts(spark, d))
    return b.groupBy("plant", F.date_format("metric_date", "yyyy-MM").alias("month")).agg(
        F.max("open_backlog_lines").alias("peak"), F.min("open_backlog_lines").alias("trough"))


YIELD_EXPRS = ["order_date as run_date", "plant", "concat('L', cast(line_no % 3 as string)) as line", "product_group",
               "ordered_weight_lb as input_lb", "invoiced_weight_lb * 0.85e0 as output_lb",
               "0.8e0 + line_no % 5 / 100e0 as std_yield_pct"]


@query("a27_yield_series", ["fact"], f"""select cast(run_date as varchar) as metric_date, plant, line, product_group,
    round(sum(input_lb), 4) as input_lb, round(sum(output_lb), 6) as output_lb, round(avg(std_yield_pct), 6) as
    std_yield_pct, round(avg((case when input_lb > 0 then output_lb / input_lb end - std_yield_pct) * 100), 6) as
    yield_variance_pct from (select {', '.join(YIELD_EXPRS)} from fact) r group by 1, 2, 3, 4""")
def yields(spark: SparkSession, d: str) -> DataFrame:
    out = s.yield_series(clean_lines(spark, d).selectExpr(*YIELD_EXPRS))
    return _day(round6(out, "std_yield_pct", "yield_variance_pct").withColumns(
        {"input_lb": F.round("input_lb", 4), "output_lb": F.round("output_lb", 6)}))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    lots = dt.lots(spark, d).select("lot_no", "production_date", "expiry_date")
    return clean_lines(spark, d).join(lots, "lot_no").select(
        F.col("issue_date").alias("snapshot_date"), F.concat(F.lit("DC-"), "plant").alias("location"), "item_no",
        "lot_no", F.col("ordered_weight_lb").alias("on_hand_lb"), "production_date", "expiry_date")


@query("a28_inventory_ageing", ["fact", "lts"], """select cast(issue_date as varchar) as metric_date, concat('DC-',
    f.plant) as location, round(sum(w), 4) as on_hand_lb, round(avg(age), 6) as mean_age_days, cast(max(age) as
    integer) as max_age_days, round(sum(case when exp - issue_date <= 5 then w else 0 end), 4) as lb_at_risk_within_5d,
    cast(count(distinct lot_no) as bigint) as lots, round(sum(age * w) / nullif(sum(w), 0), 6) as inventory_age_days
    from (select f.issue_date, f.plant, f.lot_no, f.ordered_weight_lb as w, f.issue_date - l.production_date as age,
      l.expiry_date as exp from fact f join lts l on f.lot_no = l.lot_no) f group by 1, 2""")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    out = s.inventory_series(snapshots(spark, d))
    return _day(round6(out, "mean_age_days", "inventory_age_days").withColumns(
        {c: F.round(c, 4) for c in ("on_hand_lb", "lb_at_risk_within_5d")}))


# z-scores sit on rounded rates: a rate is fixed first, so both sides score the same number
_SEV = """case when abs(z) >= 3 then 'HIGH' else 'WARN' end as severity, round_even(v, 4) as value, round_even(mu, 4) as
    baseline"""
_POOLED = f"""(select plant, metric_date, round_even(z, 2) as z, {_SEV} from (select *, (v - mu) / sd as z from (select
    plant, metric_date, v, count(*) over w as n, avg(v) over w as mu, stddev_samp(v) over w as sd from (select *,
    round(otif_rate, 6) as v from daily_plant) r window w as (partition by plant order by metric_date range between
    interval 28 days preceding and interval 1 day preceding)) a where n >= 5 and sd >= 1e-9) b where abs(z) >= 2)"""
_WEEKDAY = f"""(select plant, metric_date, round_even(z, 2) as z, {_SEV} from (select *, (v - mu) / sd as z from (select
    plant, metric_date, v, count(*) over w as n, avg(v) over w as mu, stddev_samp(v) over w as sd from (select *,
    round(otif_rate, 6) as v from daily_plant where metric_date not in (select day from hol)) r window w as (partition
    by plant, isodow(metric_date) order by metric_date rows between 8 preceding and 1 preceding)) a where n >= 5 and
    sd >= 1e-9) b where abs(z) >= 2)"""


def plant_series(spark: SparkSession, d: str) -> DataFrame:
    return round6(s.daily_series(s.daily_base(facts(spark, d)), ["plant"]), "otif_rate")


def lane_series(spark: SparkSession, d: str) -> DataFrame:
    return s.daily_series(s.daily_base(facts(spark, d)), ["plant", "customer_no"])


@query("w10_pooled_anomalies", ["daily_plant"],
       f"select plant, cast(metric_date as varchar) as metric_date, z, severity, value, baseline from {_POOLED} p")
def pooled(spark: SparkSession, d: str) -> DataFrame:
    return _day(s.pooled_anomalies(plant_series(spark, d), ["plant"], "otif_rate"))


@query("w11_weekday_anomalies", ["daily_plant", "hol"],
       f"select plant, cast(metric_date as varchar) as metric_date, z, severity, value, baseline from {_WEEKDAY} p")
def weekday(spark: SparkSession, d: str) -> DataFrame:
    return _day(s.weekday_anomalies(plant_series(spark, d), ["plant"], "otif_rate", HOLIDAYS))


_TAG = """coalesce((select min_by(anomaly_id, position) from wins where p.metric_date between start_day and end_day),
    '')"""


@query("j21_tag_windows", ["daily_plant", "wins"], f"""select plant, cast(metric_date as varchar) as metric_date,
    severity, {_TAG} as anomaly_id from {_POOLED} p""")
def tagged(spark: SparkSession, d: str) -> DataFrame:
    flags = s.pooled_anomalies(plant_series(spark, d), ["plant"], "otif_rate")
    return _day(s.tag_windows(flags, windows(spark)).select("plant", "metric_date", "severity", "anomaly_id"))


@query("e12_detector_score", ["daily_plant", "wins", "hol"], f"""select cast(count(*) as bigint) as flag_days,
    cast(count(*) filter (where a in ('A1', 'A2')) as bigint) as inside_targets, cast(count(*) filter (where a = 'A5')
    as bigint) as decoy_flags, cast(count(*) filter (where a = 'A5' and severity = 'HIGH') as bigint) as decoy_high,
    cast(count(*) filter (where a = '') as bigint) as outside, cast(min(case when a in ('A1', 'A2') then metric_date
    end) - (select min(start_day) from wins where anomaly_id in ('A1', 'A2')) as integer) as lead_days
    from (select *, {_TAG} as a from {_WEEKDAY} p) t""")
def detector(spark: SparkSession, d: str) -> DataFrame:
    flags = s.weekday_anomalies(plant_series(spark, d), ["plant"], "otif_rate", HOLIDAYS)
    return s.detector_score(flags, windows(spark), ["A1", "A2"], "A5")


_WVB = """(select anomaly_id, round_even(w, 5) as window_value, round_even(b, 5) as baseline_value, round_even(w - b, 5)
    as delta, window_rows, baseline_rows from (select anomaly_id, sum(case when i then otif_rate * lines end) /
    sum(case when i then lines end) as w, sum(case when not i then otif_rate * lines end) / sum(case when not i then
    lines end) as b, cast(count(*) filter (where i) as bigint) as window_rows, cast(count(*) filter (where not i) as
    bigint) as baseline_rows from (select *, metric_date >= start_day as i from daily_plant join wins on metric_date
    between start_day - 56 and end_day) j group by 1) g)"""


@query("j21_window_vs_baseline", ["daily_plant", "wins"], f"select * from {_WVB} v")
def window_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    series = s.daily_series(s.daily_base(facts(spark, d)), ["plant"])
    return s.window_vs_baseline(series, windows(spark), "otif_rate", "lines", 56)


@query("e11_anomaly_effect", ["daily_plant", "wins"], f"""select w.anomaly_id, w.direction, w.min_abs, v.delta,
    coalesce(case when w.direction = 'down' then v.delta < 0 else v.delta > 0 end and abs(v.delta) >= w.min_abs, false)
    as ok from wins w left join {_WVB} v using (anomaly_id)""")
def effect(spark: SparkSession, d: str) -> DataFrame:
    series = s.daily_series(s.daily_base(facts(spark, d)), ["plant"])
    measured = s.window_vs_baseline(series, windows(spark), "otif_rate", "lines", 56)
    return s.effect_check(measured, windows(spark)).select("anomaly_id", "direction", "min_abs", "delta", "ok")


@query("t04_lane_contributions", ["daily_lane"], """select customer_no, round(delta, 6) as delta, round(n / total, 6) as
    volume_share, round(delta * n / total, 6) as weighted_contribution from (select *, sum(n) over () as total from
    (select customer_no, sum(case when i then lines end) as n, count(*) filter (where not i) as base, sum(case when i
    then otif_rate * lines end) / sum(case when i then lines end) - sum(case when not i then otif_rate * lines end) /
    sum(case when not i then lines end) as delta from (select *, metric_date >= date '1997-01-01' as i from daily_lane
    where plant = 'PLT-02' and metric_date between date '1997-01-01' - 365 and date '1997-12-31') x group by 1) g) h
    where n >= 5 and base > 0 order by delta * n / total, customer_no limit 10""")
def contributions(spark: SparkSession, d: str) -> DataFrame:
    lanes = lane_series(spark, d).where("plant = 'PLT-02'")
    out = s.lane_contributions(lanes, date(1997, 1, 1), date(1997, 12, 31), 365, 10)
    return round6(out, "delta", "volume_share", "weighted_contribution")
