"""Daily series from the facts, the backlog, and anomaly detection on the series.

Facts are folded to one row per day and segment first; every window runs over that calendar, never over lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z_WARN, Z_HIGH = 2.0, 3.0
BASELINE_DAYS = 28
SAME_WEEKDAY_POINTS = 8
MIN_POINTS = 5
BLACKOUT_DAYS = 2  # either side of a holiday
AT_RISK_DAYS = 5


def delivery_fact(lines: DataFrame) -> DataFrame:
    """Lines with lane, on_time, in_full and otif as 0/1, and days late (never negative)."""
    on_time = F.coalesce(F.col("issue_date") <= F.col("confirmed_delivery_date"), F.lit(False))
    by_weight = F.col("invoiced_weight_lb") >= F.col("ordered_weight_lb") * (1 - 0.02)
    by_count = F.col("invoiced_qty") >= F.col("ordered_qty")
    in_full = F.coalesce(F.when(F.coalesce("catch_weight_flag", F.lit(False)), by_weight).otherwise(by_count),
                         F.lit(False))
    late = F.datediff("issue_date", "confirmed_delivery_date")
    return lines.withColumns({
        "lane": F.concat("plant", F.lit(" > "), "customer_no"), "on_time": on_time.cast("int"),
        "in_full": in_full.cast("int"), "otif": (on_time & in_full).cast("int"),
        "late_days": F.greatest(late, F.lit(0)), "metric_date": F.col("issue_date")})


_SUMS = {"lines": "1", "otif_n": "otif", "on_time_n": "on_time", "inv_q": "invoiced_qty", "ord_q": "ordered_qty",
         "inv_w": "invoiced_weight_lb", "ord_w": "ordered_weight_lb"}
GRAINS = {"total": [], "plant": ["plant"], "lane": ["plant", "customer_no"],
          "plant_group": ["plant", "product_group"]}


def daily_base(fact: DataFrame) -> DataFrame:
    """Additive sums at the finest grain any series needs; every series is a roll-up of this."""
    return fact.groupBy("metric_date", "plant", "customer_no", "product_group").agg(
        *[F.sum(F.expr(c)).alias(n) for n, c in _SUMS.items()])


def daily_series(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = base.groupBy("metric_date", *keys).agg(*[F.sum(n).alias(n) for n in _SUMS])
    div = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return g.select("metric_date", *keys, "lines", div("otif_n", "lines").alias("otif_rate"),
                    div("on_time_n", "lines").alias("on_time_rate"), div("inv_q", "ord_q").alias("fill_rate_count"),
                    div("inv_w", "ord_w").alias("fill_rate_weight"), F.col("ord_w").alias("ordered_weight_lb"))


def backlog(fact: DataFrame) -> DataFrame:
    """Lines ordered but not issued, per plant, as at every date on which anything was issued.

    An open line is +1 on its order date and -1 on its issue date; lines issued on or before their order date are
    never open. Day totals per plant are small, so the running sum needs no join of lines to dates.
    """
    open_lines = fact.where("metric_date > order_date")
    steps = open_lines.select("plant", F.explode(F.array(
        F.struct(F.col("order_date").alias("day"), F.lit(1).alias("step")),
        F.struct(F.col("metric_date").alias("day"), F.lit(-1).alias("step")))).alias("_s")).select("plant", "_s.*")
    change = steps.groupBy("plant", "day").agg(F.sum("step").alias("change"))
    grid = fact.select("plant").distinct().crossJoin(fact.select(F.col("metric_date").alias("day")).distinct())
    days = grid.select("plant", "day", F.lit(0).cast("bigint").alias("change"), F.lit(True).alias("wanted")) \
        .unionByName(change.withColumn("wanted", F.lit(False)))
    daily = days.groupBy("plant", "day").agg(F.sum("change").alias("change"), F.max("wanted").alias("wanted"))
    running = Window.partitionBy("plant").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("open_backlog_lines", F.sum("change").over(running)).where("wanted").select(
        F.col("day").alias("metric_date"), "plant", "open_backlog_lines")


def yield_series(runs: DataFrame) -> DataFrame:
    """Daily input, output, standard yield and variance in points per plant, line and product group."""
    actual = F.when(F.col("input_lb") > 0, F.col("output_lb") / F.col("input_lb"))
    f = runs.withColumn("yield_variance_pct", (actual - F.col("std_yield_pct")) * 100)
    return f.groupBy(F.col("run_date").alias("metric_date"), "plant", "line", "product_group").agg(
        F.sum("input_lb").alias("input_lb"), F.sum("output_lb").alias("output_lb"),
        F.avg("std_yield_pct").alias("std_yield_pct"), F.avg("yield_variance_pct").alias("yield_variance_pct"))


def inventory_series(snapshots: DataFrame) -> DataFrame:
    """Daily stock per location: weight-weighted age, mean and maximum age, pounds near expiry, distinct lots."""
    age = F.datediff("snapshot_date", "production_date")
    left = F.datediff("expiry_date", "snapshot_date")
    g = snapshots.withColumns({"age_days": age, "days_to_expiry": left}).groupBy(
        F.col("snapshot_date").alias("metric_date"), "location").agg(
        F.sum("on_hand_lb").alias("on_hand_lb"), F.sum(F.col("age_days") * F.col("on_hand_lb")).alias("_age_lb"),
        F.avg("age_days").alias("mean_age_days"), F.max("age_days").alias("max_age_days"),
        F.sum(F.when(F.col("days_to_expiry") <= AT_RISK_DAYS, F.col("on_hand_lb")).otherwise(0.0))
        .alias("lb_at_risk_within_5d"), F.count_distinct("lot_no").alias("lots"))
    return g.withColumn("inventory_age_days", F.when(F.col("on_hand_lb") > 0, F.col("_age_lb") / F.col("on_hand_lb"))) \
        .drop("_age_lb")


# ---- anomalies -----------------------------------------------------------------------------------------------

def _score(scored: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    z = (F.col(value) - F.col("_mean")) / F.col("_sd")
    usable = (F.col("_n") >= MIN_POINTS) & (F.col("_sd") >= 1e-9)
    severity = F.when(F.abs(z) >= Z_HIGH, "HIGH").when(F.abs(z) >= Z_WARN, "WARN")
    return scored.where(usable).withColumn("severity", severity).where(F.col("severity").isNotNull()).select(
        *keys, "metric_date", F.bround(z, 2).alias("z"), "severity", F.bround(F.col(value), 4).alias("value"),
        F.bround(F.col("_mean"), 4).alias("baseline"))


def _baseline(df: DataFrame, value: str, frame) -> DataFrame:  # noqa: ANN001
    return df.withColumns({"_n": F.count(F.lit(1)).over(frame), "_mean": F.avg(value).over(frame),
                           "_sd": F.stddev_samp(value).over(frame)})


def pooled_anomalies(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Days far from the previous 28 calendar days, all weekdays pooled."""
    frame = Window.partitionBy(*keys).orderBy(F.unix_date("metric_date")).rangeBetween(-BASELINE_DAYS, -1)
    return _score(_baseline(series, value, frame), keys, value)


def blackout(day: Column, holidays: Sequence[date]) -> Column:
    """Within two days of a holiday. The calendar is a short list, so the test is a literal set."""
    days = sorted({h + timedelta(days=n) for h in holidays for n in range(-BLACKOUT_DAYS, BLACKOUT_DAYS + 1)})
    return day.isin(*days) if days else F.lit(False)


def weekday_anomalies(series: DataFrame, keys: Sequence[str], value: str, holidays: Sequence[date]) -> DataFrame:
    """Days far from the last eight same weekdays; days around a holiday are neither scored nor a baseline."""
    usable = series.where(~blackout(F.col("metric_date"), holidays)).withColumn("_dow", F.weekday("metric_date"))
    frame = Window.partitionBy(*keys, "_dow").orderBy("metric_date").rowsBetween(-SAME_WEEKDAY_POINTS, -1)
    return _score(_baseline(usable, value, frame), keys, value)


def tag_windows(flags: DataFrame, windows: DataFrame) -> DataFrame:
    """Each flagged day with the first labelled window (position order) it falls in; '' outside all.

    `windows` (position, anomaly_id, start, end) is a short labelled list; it is aggregated to one array row, so
    the tagging is an expression per day and needs no range join.
    """
    listed = windows.agg(F.array_sort(F.collect_list(F.struct(
        "position", "anomaly_id", "start", "end"))).alias("_w"))
    hit = F.filter("_w", lambda w: F.col("metric_date").between(w["start"], w["end"]))
    return flags.crossJoin(F.broadcast(listed)).withColumn(
        "anomaly_id", F.coalesce(F.try_element_at(hit, F.lit(1))["anomaly_id"], F.lit(""))).drop("_w")


def detector_score(flags: DataFrame, windows: DataFrame, targets: Sequence[str], decoy: str) -> DataFrame:
    """Flagged days inside the target windows, on the decoy, and outside every window; days to the first hit."""
    tagged = tag_windows(flags, windows)
    is_target = F.col("anomaly_id").isin(*targets)
    starts = windows.where(F.col("anomaly_id").isin(*targets)).agg(F.min("start").alias("_start"))
    one = tagged.agg(
        F.count(F.lit(1)).alias("flag_days"), F.count_if(is_target).alias("inside_targets"),
        F.count_if(F.col("anomaly_id") == decoy).alias("decoy_flags"),
        F.count_if((F.col("anomaly_id") == decoy) & (F.col("severity") == "HIGH")).alias("decoy_high"),
        F.count_if(F.col("anomaly_id") == "").alias("outside"),
        F.min(F.when(is_target, F.col("metric_date"))).alias("_first"))
    return one.crossJoin(F.broadcast(starts)).withColumn(
        "lead_days", F.datediff("_first", "_start")).drop("_first", "_start")


def window_vs_baseline(series: DataFrame, windows: DataFrame, value: str, weight: str | None,
                       baseline_days: int) -> DataFrame:
    """Per labelled window: the (weighted) mean inside it and over the days before it, and the difference.

    `windows` is a short labelled list, so the interval test runs against a broadcast of it.
    """
    w = windows.withColumn("_from", F.date_sub("start", baseline_days))
    j = series.join(F.broadcast(w), F.col("metric_date").between(F.col("_from"), F.col("end")))
    inside = F.col("metric_date") >= F.col("start")
    x = F.col(value)
    wt = F.col(weight) if weight else F.when(x.isNotNull(), F.lit(1.0))

    def mean(keep: Column) -> Column:
        return F.try_divide(F.sum(F.when(keep, x * wt)), F.sum(F.when(keep, wt)).cast("double"))

    g = j.groupBy("anomaly_id").agg(
        mean(inside).alias("_w"), mean(~inside).alias("_b"), F.count_if(inside).alias("window_rows"),
        F.count_if(~inside).alias("baseline_rows"))
    return g.select("anomaly_id", F.bround("_w", 5).alias("window_value"), F.bround("_b", 5).alias("baseline_value"),
                    F.bround(F.col("_w") - F.col("_b"), 5).alias("delta"), "window_rows", "baseline_rows")


def effect_check(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each seeded window moved in its direction by at least its minimum (anomaly_id, direction, min_abs)."""
    j = expected.join(measured, "anomaly_id", "left")
    moved = F.when(F.col("direction") == "down", F.col("delta") < 0).otherwise(F.col("delta") > 0)
    return j.withColumn("ok", F.coalesce(moved & (F.abs("delta") >= F.col("min_abs")), F.lit(False)))


def lane_contributions(lanes: DataFrame, start: date, end: date, baseline_days: int = 56, k: int | None = None
                       ) -> DataFrame:
    """Segments by their share of a plant's change: (window mean - baseline mean) x share of the window's lines.

    Segments with fewer than five window lines or no baseline are left out; most negative first.
    """
    day, first = F.col("metric_date"), F.lit(start - timedelta(days=baseline_days))
    inside = day.between(F.lit(start), F.lit(end))
    before = (day >= first) & (day < F.lit(start))

    def mean(keep: Column) -> Column:
        return F.try_divide(F.sum(F.when(keep, F.col("otif_rate") * F.col("lines"))),
                            F.sum(F.when(keep, F.col("lines"))).cast("double"))

    g = lanes.where(inside | before).groupBy("customer_no").agg(
        F.sum(F.when(inside, F.col("lines"))).alias("window_lines"), F.count_if(before).alias("_base"),
        (mean(inside) - mean(before)).alias("delta"))
    total = g.agg(F.sum("window_lines").alias("_total"))
    out = g.where("window_lines >= 5 and _base > 0").crossJoin(F.broadcast(total)).select(
        "customer_no", "delta", (F.col("window_lines") / F.col("_total")).alias("volume_share"),
        (F.col("delta") * F.col("window_lines") / F.col("_total")).alias("weighted_contribution"))
    ranked = out.orderBy("weighted_contribution", "customer_no")
    return ranked.limit(k) if k else ranked
