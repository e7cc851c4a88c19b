"""The canonical order line, the field dictionary and the fixed names the operators share."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Canonical column, kind, whether a mapping must supply it, and the name ideas it is found by
# (one group per idea, spellings within a group are interchangeable).
CANONICAL = [
    ("order_no", "order_id", True, [["order"], ["no"]]),
    ("line_no", "line", True, [["line"]]),
    ("customer_no", "customer", True, [["customer"], ["no"]]),
    ("item_no", "item", True, [["item"], ["no"]]),
    ("plant", "plant", True, [["plant"]]),
    ("order_date", "date", True, [["order"], ["date"]]),
    ("requested_date", "date", True, [["requested"], ["date"]]),
    ("confirmed_delivery_date", "date", True, [["confirmed"], ["delivery"], ["date"]]),
    ("issue_date", "date", True, [["issue", "ship"], ["date"]]),
    ("ordered_qty", "qty", True, [["order"], ["qty"]]),
    ("invoiced_qty", "qty", False, [["invoiced", "ship"], ["qty"]]),
    ("ordered_weight_lb", "weight", False, [["order"], ["weight"]]),
    ("invoiced_weight_lb", "weight", False, [["invoiced", "ship"], ["weight"]]),
    ("uom", "uom", False, [["uom"]]),
    ("lot_no", "lot", False, [["lot"], ["no"]]),
]
COLUMNS = [c[0] for c in CANONICAL]
KIND = {c[0]: c[1] for c in CANONICAL}
REQUIRED = [c[0] for c in CANONICAL if c[2]]
SQL_TYPE = {"line": "int", "date": "date", "qty": "double", "weight": "double"}

# The row transforms a mapping may ask for.
DATE_PARSERS = ["parse_date_iso", "parse_date_us", "parse_date_dmy", "parse_excel_serial"]
TRANSFORMS = ["trim", *DATE_PARSERS, "kg_to_lb", "normalize_customer_no"]
LB_PER_KG = 2.2046226218

# Every column a published line carries.
GOLD_COLUMNS = [
    "order_no", "line_no", "customer_no", "item_no", "plant", "product_group", "catch_weight_flag",
    "order_date", "requested_date", "confirmed_delivery_date", "issue_date", "ordered_qty", "invoiced_qty",
    "ordered_weight_lb", "invoiced_weight_lb", "uom", "lot_no", "production_date", "expiry_date",
    "customer_po", "order_type", "batch_id", "source", "source_row", "published_at",
]


@dataclass(frozen=True)
class Dated:
    """A field required only on lines whose `by` date is on or after `start`."""

    column: str
    start: date
    by: str
    owner: str
    fix: str
    before: str


@dataclass(frozen=True)
class FieldDictionary:
    version: int = 1
    owner: str = "data_governance"
    always: list[str] = field(default_factory=lambda: list(REQUIRED))
    dated: list[Dated] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name in self.always:
            if name not in REQUIRED:
                raise ValueError(f"{name} cannot be required on every line: a mapping may leave it out")
        for d in self.dated:
            if d.column not in KIND or KIND.get(d.by) != "date":
                raise ValueError(f"{d.column}: needs a canonical column and a canonical date")


def lot_dictionary(start: date = date(2026, 6, 1), version: int = 2) -> FieldDictionary:
    """The current dictionary: lot_no is required on lines issued from `start`."""
    return FieldDictionary(version=version, dated=[Dated(
        "lot_no", start, "issue_date", "quality",
        # Advice shown on the exception.
        "Plant to send lot_no on the extract and resend the line; quality to confirm the lot shipped",
        "Not covered: shipped before lot_no was required and the source did not carry it. No fix at source; "
        "report the line as not covered for this period")])


def canonical_fields(spark: SparkSession) -> DataFrame:
    """The canonical schema as rows, for joins against profiles."""
    rows = [(i, name, kind, required, groups) for i, (name, kind, required, groups) in enumerate(CANONICAL)]
    return spark.createDataFrame(
        rows, "field_order int, canonical_col string, kind string, required boolean, "
              "concepts array<array<string>>")
