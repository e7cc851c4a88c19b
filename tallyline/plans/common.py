"""Inputs several query modules share, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.joins import keep_first, lookup
from tallyline.plans.registry import cte
from tallyline.schema import REQUIRED
from tallyline.sources import driver_tables as dt


def round6(df: DataFrame, *names: str) -> DataFrame:
    """Rates at six decimals, so that the order of a sum does not show."""
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with every required field, the first of each order line, with item and customer attributes."""
    lines = dt.order_lines(spark, d).drop("has_lot", "bad_issue", "batch_id")
    complete: Column = F.lit(True)
    for c in REQUIRED:
        complete = complete & F.col(c).isNotNull()
    first = keep_first(lines.where(complete), ["order_no", "line_no"], ["source_row"])
    with_items = lookup(first, dt.items(spark, d).drop("uom"), "item_no", ["source_row"])
    return lookup(with_items, dt.customers(spark, d), "customer_no", ["source_row"])


cte("fact", ["ol", "its", "custs"], f"""select x.*, i.item_name, i.product_group, i.catch_weight_flag,
  i.avg_lb_per_case, c.customer_name, c.city, c.channel from (select * exclude (rn, has_lot, bad_issue, batch_id)
  from (select *, row_number() over (partition by order_no, line_no order by source_row) as rn from ol
        where {' and '.join(f'{c} is not null' for c in REQUIRED)}) r where rn = 1) x
  left join its i on x.item_no = i.item_no left join custs c on x.customer_no = c.customer_no""")
cte("flags", ["fact"], """select *, coalesce(issue_date <= confirmed_delivery_date, false) as gov_on_time,
  coalesce(issue_date <= requested_date, false) as req_on_time,
  coalesce(invoiced_qty >= ordered_qty, false) as count_in_full,
  coalesce(case when catch_weight_flag then invoiced_weight_lb >= ordered_weight_lb * cast(0.98 as double)
    else invoiced_qty >= ordered_qty end, false) as gov_in_full,
  coalesce(invoiced_qty >= ordered_qty * cast(0.98 as double), false) as tol_in_full,
  substr(cast(issue_date as varchar), 1, 7) as month from fact""")
