import pytest
from pyspark.sql import functions as F

from tallyline.functions import transforms as tf
from tallyline.functions.text import fill, shape

CASES = [
    ("issue_date", ["parse_date_iso"], "2025-03-04", "2025-03-04", False),
    ("issue_date", ["parse_date_iso"], "03/04/2025", None, True),
    ("issue_date", ["parse_date_us"], "3/4/2025", "2025-03-04", False),
    ("issue_date", ["parse_date_us"], "31/12/2025", None, True),
    ("issue_date", ["parse_date_dmy"], "31/12/2025", "2025-12-31", False),
    ("issue_date", ["parse_excel_serial"], "45720", "2025-03-04", False),
    ("issue_date", ["parse_excel_serial"], "45720.5", None, True),
    ("issue_date", ["parse_date_iso"], "  ", None, False),
    ("ordered_weight_lb", ["kg_to_lb"], "10", "22.046226218", False),
    ("ordered_qty", [], "1d", None, True),
    ("ordered_qty", [], "NaN", None, True),
    ("ordered_qty", [], "1e3", "1000.0", False),
    ("line_no", [], "3", "3", False),
    ("line_no", [], "3.5", None, True),
    ("customer_no", ["normalize_customer_no"], "CUST-0123", "C000123", False),
    ("customer_no", ["normalize_customer_no"], "1234567", "C1234567", False),
    ("customer_no", ["normalize_customer_no"], "n/a", None, True),
    ("customer_no", ["normalize_customer_no"], "000", "C000000", False),
    ("item_no", ["trim"], "\tIT1  ", "IT1", False),
]


@pytest.mark.parametrize("canonical,steps,raw,value,bad", CASES)
def test_typed(spark, canonical, steps, raw, value, bad):
    df = spark.createDataFrame([(raw,)], "raw string")
    out = tf.typed(F.col("raw"), canonical, steps)
    row = df.select(out.cast("string").alias("v"), tf.parse_error(F.col("raw"), out).alias("e")).first()
    assert row.v == value
    assert row.e == (raw if bad else None)


def test_shape_and_fill(spark):
    df = spark.createDataFrame([("IT00012  ", None)], "a string, b string")
    row = df.select(shape(F.col("a")).alias("s"), fill("x {a}|{b}|{c}", {"a": F.trim("a"), "b": F.col("b")})
                    .alias("f")).first()
    assert row.s == "AA99999··"
    assert row.f == "x IT00012|None|?"
