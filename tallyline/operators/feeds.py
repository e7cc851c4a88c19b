"""Exports of two reporting tools, each with its own definition of on time, in full and scope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ToolSpec:
    date_basis: str
    case_tolerance: float = 0.0
    excluded_order_types: tuple[str, ...] = ()


LINE_TOOL = ToolSpec("confirmed_delivery_date")
MONTHLY_TOOL = ToolSpec("requested_date", 0.02, ("CONS",))


def tool_flags(lines: DataFrame, spec: ToolSpec) -> DataFrame:
    """The tool's own verdict per line."""
    on_time = F.coalesce(F.col("issue_date") <= F.col(spec.date_basis), F.lit(False))
    in_full = F.coalesce(F.col("invoiced_qty") >= F.col("ordered_qty") * (1 - spec.case_tolerance), F.lit(False))
    scope = F.lit(True)
    if spec.excluded_order_types:
        scope = ~F.coalesce(F.col("order_type").isin(*spec.excluded_order_types), F.lit(False))
    return lines.select("*", on_time.alias("tool_on_time"), in_full.alias("tool_in_full"),
                        (on_time & in_full).alias("tool_otif"), scope.alias("in_scope"))


def line_report(lines: DataFrame, company: str) -> DataFrame:
    """The line-level delivery report, twenty columns. `lines` carries customer and item attributes."""
    f = tool_flags(lines, LINE_TOOL)
    fill = F.when(F.col("ordered_qty") > 0, F.col("invoiced_qty") / F.col("ordered_qty"))
    none = F.lit(None).cast("string")
    return f.select(
        F.lit(company).alias("Company Name"), F.col("customer_no").alias("Customer Number"),
        F.col("customer_name").alias("Customer Name"), F.col("city").alias("City"),
        F.col("order_no").alias("Customer Order Number"), none.alias("Customer PO Number"),
        F.col("order_type").alias("Customer Order Type"), F.col("line_no").alias("Order Line Number"),
        F.col("item_no").alias("Item Number"), F.col("item_name").alias("Item Name"),
        F.col("product_group").alias("Product Group"),
        F.col("confirmed_delivery_date").alias("Confirmed Delivery Date"),
        F.col("requested_date").alias("Planning Date"), F.col("issue_date").alias("Issue Date"),
        F.datediff("issue_date", "requested_date").alias("Days Between Planning and Issue Date"),
        F.col("ordered_qty").alias("Ordered Qty"), F.col("invoiced_qty").alias("Invoiced Qty"),
        F.bround(fill, 4).alias("Case Fill Rate"),
        F.bround(F.least(fill, F.when(fill.isNotNull(), F.lit(1.0))), 4).alias("Case Fill Rate max. 100%"),
        F.when(F.col("tool_on_time"), "Y").otherwise("N").alias("On Time"))


def line_verdicts(report: DataFrame) -> DataFrame:
    """The report's keys, order type and verdicts under plain names."""
    return report.select(
        F.col("Customer Order Number").alias("order_no"), F.col("Order Line Number").alias("line_no"),
        F.col("Customer Order Type").alias("order_type"), F.col("Issue Date").alias("issue_date"),
        (F.col("On Time") == "Y").alias("tool_on_time"),
        F.coalesce(F.col("`Case Fill Rate max. 100%`") >= 1.0, F.lit(False)).alias("tool_in_full"))


def monthly_report(lines: DataFrame) -> DataFrame:
    """The month x plant x customer export; the excluded order types are silently left out."""
    f = tool_flags(lines, MONTHLY_TOOL).where("in_scope")
    g = f.groupBy(F.date_format("issue_date", "yyyy-MM").alias("month"), "plant", "customer_no",
                  "customer_name").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("tool_on_time").alias("on_time_lines"),
        F.count_if("tool_in_full").alias("in_full_lines"), F.count_if("tool_otif").alias("otif_lines"),
        F.sum("ordered_qty").alias("ordered_cases"), F.sum("invoiced_qty").alias("shipped_cases"))
    return g.select("*", *[
        F.bround(F.try_divide(100 * F.col(a), F.col(b)), 1).alias(n) for n, a, b in (
            ("otif_pct", "otif_lines", "lines"), ("on_time_pct", "on_time_lines", "lines"),
            ("fill_pct", "shipped_cases", "ordered_cases"))])


def gap_truth(lines: DataFrame) -> DataFrame:
    """Per month: governed rate, both tools' rates and gaps, single-switch deltas and lines out of scope.

    An independent derivation of what the reconciliation finds, straight from the lines.
    """
    gov_time = F.col("issue_date") <= F.col("confirmed_delivery_date")
    by_count = F.col("invoiced_qty") >= F.col("ordered_qty")
    by_weight = F.col("invoiced_weight_lb") >= F.col("ordered_weight_lb") * 0.98
    gov_full = F.when(F.coalesce("catch_weight_flag", F.lit(False)), by_weight).otherwise(by_count)
    req_time = F.col("issue_date") <= F.col("requested_date")
    tolerant = F.col("invoiced_qty") >= F.col("ordered_qty") * 0.98
    scope = F.col("order_type") != "CONS"

    def rate(c):  # noqa: ANN001, ANN202
        return F.avg(F.coalesce(c, F.lit(False)).cast("double"))

    g = lines.groupBy(F.date_format("issue_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("lines"), rate(gov_time & gov_full).alias("_g"),
        rate(gov_time & by_count).alias("_1"),
        F.try_divide(F.count_if(req_time & tolerant & scope).cast("double"),
                     F.count_if(scope).cast("double")).alias("_2"),
        rate(req_time & gov_full).alias("_d"), rate(gov_time & tolerant).alias("_t"),
        F.count_if(~scope).alias("scope_filter_lines_dropped"))
    r = lambda c: F.bround(c, 5)
    return g.select("month", "lines", r(F.col("_g")).alias("governed_otif"), r(F.col("_1")).alias("tool1_otif"),
                    r(F.col("_2")).alias("tool2_otif"), r(F.col("_1") - F.col("_g")).alias("tool1_gap"),
                    r(F.col("_2") - F.col("_g")).alias("tool2_gap"),
                    r(F.col("_1") - F.col("_g")).alias("weight_basis"),
                    r(F.col("_d") - F.col("_g")).alias("date_basis"),
                    r(F.col("_t") - F.col("_g")).alias("case_tolerance"), "scope_filter_lines_dropped")
