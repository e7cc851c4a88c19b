"""Row transforms a confirmed mapping may ask for. Each is one JVM expression on the raw text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.text import strip, zfill
from tallyline.schema import DATE_PARSERS, KIND, LB_PER_KG, SQL_TYPE

# What counts as a number. try_cast alone would also take '1d', '2.5f' and 'NaN'.
NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
# Single-letter month and day take one or two digits.
DATE_FORMATS = {"parse_date_iso": "yyyy-M-d", "parse_date_us": "M/d/yyyy", "parse_date_dmy": "d/M/yyyy"}
EXCEL_EPOCH = "1899-12-30"


def number(text: Column) -> Column:
    """The text as a double, NULL when it is not a plain number."""
    s = strip(text)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def parse_date(text: Column, parser: str) -> Column:
    """The text as a date by one named parser, NULL when it does not fit."""
    if parser == "parse_excel_serial":
        n = number(text)
        whole = (n % 1 == 0) & (n.between(-600000, 2800000))  # outside this no calendar date exists
        return F.when(whole, F.date_add(F.lit(EXCEL_EPOCH).cast("date"), n.cast("int")))
    return F.try_to_date(strip(text), DATE_FORMATS[parser])


def customer_no(text: Column) -> Column:
    """Digits only, leading zeros dropped, as C and at least six digits; NULL without a digit."""
    digits = F.regexp_replace(text, r"\D", "")
    core = F.regexp_replace(digits, "^0+", "")
    return F.when(F.length(digits) > 0, F.concat(
        F.lit("C"), zfill(F.when(core == "", F.lit("0")).otherwise(core), 6)))


def typed(raw: Column, canonical: str, transforms: Sequence[str]) -> Column:
    """The raw text as the canonical column's type after its transforms; blank and unparseable are NULL."""
    kind = KIND[canonical]
    text = strip(raw) if "trim" in transforms else raw
    blank = raw.isNull() | (strip(raw) == "")
    if kind == "date":
        parser = next(t for t in transforms if t in DATE_PARSERS)
        value = parse_date(text, parser)
    elif kind in ("qty", "weight"):
        value = number(text) * F.lit(LB_PER_KG) if "kg_to_lb" in transforms else number(text)
    elif kind == "line":
        n = number(text)
        value = F.when((n % 1 == 0) & (F.abs(n) < 2147483648), n.cast("int"))
    elif kind == "customer" and "normalize_customer_no" in transforms:
        value = customer_no(text)
    else:
        value = text
    return F.when(~blank, value).cast(SQL_TYPE.get(kind, "string"))


def parse_error(raw: Column, value: Column) -> Column:
    """The raw text when it is not blank and produced no value, else NULL."""
    return F.when(value.isNull() & raw.isNotNull() & (strip(raw) != ""), raw)
