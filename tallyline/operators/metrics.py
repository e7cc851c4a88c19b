"""Versioned metric definitions, written once as configuration and turned into DataFrames.

A definition holds Spark SQL expressions: flags (inputs, then rules that may use earlier flags) and
aggregations over columns or flags. Catalyst does the parsing; `check_expression` only walks its result to
refuse anything outside the small set a metric may use.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MetricError(ValueError):
    pass


@dataclass(frozen=True)
class Metric:
    name: str
    version: int
    status: str
    inputs: dict[str, str] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    aggregations: dict[str, str] = field(default_factory=dict)
    params: dict[str, float] = field(default_factory=dict)
    key: tuple[str, ...] = ("order_no", "line_no")
    period: str = "issue_date"
    dimensions: tuple[str, ...] = ("plant", "customer_no", "item_no", "product_group", "order_type")

    @property
    def flags(self) -> dict[str, str]:
        return {**self.inputs, **self.rules}

    @property
    def view(self) -> str:
        return f"{self.name}_v{self.version}_lines"


_RATES = {"lines": "count(*)", "otif_lines": "sum(otif)", "on_time_lines": "sum(on_time)",
          "in_full_lines": "sum(in_full)", "otif_rate": "sum(otif) / count(*)",
          "on_time_rate": "sum(on_time) / count(*)", "in_full_rate": "sum(in_full) / count(*)"}
_OTIF_RATE = {n: _RATES[n] for n in ("lines", "otif_lines", "otif_rate")}
_CONFIRMED = "issue_date <= confirmed_delivery_date"
_BY_COUNT = "invoiced_qty >= ordered_qty"
_BY_WEIGHT = "invoiced_weight_lb >= ordered_weight_lb * (1 - tolerance_weight)"

# The governed definitions.
METRICS = [
    Metric("otif", 3, "current", {"on_time": _CONFIRMED, "in_full_count": _BY_COUNT, "in_full_weight": _BY_WEIGHT},
           {"in_full": "if(catch_weight_flag, in_full_weight, in_full_count)", "otif": "on_time and in_full"},
           _RATES, {"tolerance_weight": 0.02}),
    Metric("otif", 2, "legacy", {"on_time": _CONFIRMED, "in_full_count": _BY_COUNT},
           {"in_full": "in_full_count", "otif": "on_time and in_full"}, _RATES),
    Metric("otif_date_basis", 1, "reference",
           {"on_time": "issue_date <= requested_date", "in_full_count": _BY_COUNT, "in_full_weight": _BY_WEIGHT},
           {"in_full": "if(catch_weight_flag, in_full_weight, in_full_count)", "otif": "on_time and in_full"},
           _OTIF_RATE, {"tolerance_weight": 0.02}),
    Metric("otif_case_tolerance", 1, "reference",
           {"on_time": _CONFIRMED, "in_full_count_tolerance": "invoiced_qty >= ordered_qty * (1 - case_tolerance)"},
           {"in_full": "in_full_count_tolerance", "otif": "on_time and in_full"},
           _OTIF_RATE, {"case_tolerance": 0.02}),
    Metric("fill_rate", 1, "current", aggregations={
        "lines": "count(*)", "fill_rate_count": "sum(invoiced_qty) / sum(ordered_qty)",
        "fill_rate_weight": "sum(invoiced_weight_lb) / sum(ordered_weight_lb)",
        "ordered_weight_lb": "sum(ordered_weight_lb)", "invoiced_weight_lb": "sum(invoiced_weight_lb)",
        "ordered_qty": "sum(ordered_qty)", "invoiced_qty": "sum(invoiced_qty)"}),
]
BY_VERSION = {(m.name, m.version): m for m in METRICS}

# Consumer views and the pairs that must agree.
CONSUMERS = {
    "ops_otif_monthly_plant": ("otif", 3, ("month", "plant")),
    "sales_otif_daily_customer": ("otif", 3, ("day", "plant", "customer_no")),
    "legacy_otif_monthly_plant": ("otif", 2, ("month", "plant")),
    "ops_fill_rate_monthly_plant": ("fill_rate", 1, ("month", "plant")),
    "sales_fill_rate_daily_customer": ("fill_rate", 1, ("day", "plant", "customer_no")),
}
PAIRS = [
    ("otif", "otif_lines", "lines", "ops_otif_monthly_plant", "sales_otif_daily_customer",
     "legacy_otif_monthly_plant"),
    ("fill_rate", "invoiced_weight_lb", "ordered_weight_lb", "ops_fill_rate_monthly_plant",
     "sales_fill_rate_daily_customer", None),
]

_COMMON = {"Literal", "UnresolvedAttribute", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual",
           "EqualTo", "Not", "And", "Or", "In", "Add", "Subtract", "Multiply", "Divide", "UnaryMinus", "CaseWhen",
           "UnresolvedFunction", "UnresolvedStar"}
_ROW_FUNCTIONS = {"if", "negative", "+", "-", "*", "/", "=", "==", "<>", "!=", "<", "<=", ">", ">=", "and", "or",
                  "not", "in"}
_CONSTANTS = ("boolean", "int", "bigint", "double", "decimal", "string")
_AGGREGATES = {"sum", "avg", "count", "min", "max"}


def check_expression(spark: SparkSession, text: str, aggregate: bool) -> set[str]:
    """Column names an expression reads; refuses calls and constructs a metric may not use."""
    node = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    names: set[str] = set()

    def walk(n, inside: bool) -> None:  # noqa: ANN001  a JVM expression
        kind = n.getClass().getSimpleName()
        if kind not in _COMMON:
            raise MetricError(f"{text!r}: {kind} is not allowed in a metric")
        if kind == "Literal" and n.dataType().simpleString().split("(")[0] not in _CONSTANTS:
            raise MetricError(f"{text!r}: only true/false, numbers and text may be constants")
        if kind == "UnresolvedAttribute":
            names.add(n.sql().replace("`", ""))
            if aggregate and not inside:
                raise MetricError(f"{text!r}: a column must be inside an aggregate")
        if kind == "UnresolvedFunction":
            fn = n.nameParts().mkString(".").lower()
            if fn in _AGGREGATES:
                if not aggregate or inside:
                    raise MetricError(f"{text!r}: {fn}() is not allowed here")
                inside = True
            elif fn not in _ROW_FUNCTIONS:
                raise MetricError(f"{text!r}: function {fn} is not allowed in a metric")
        children = n.children()
        for i in range(children.size()):
            walk(children.apply(i), inside)

    walk(node, False)
    return names


def check(spark: SparkSession, m: Metric) -> None:
    """Refuse a definition whose names clash or whose expressions reach outside what a metric may say."""
    groups = [set(m.params), set(m.inputs), set(m.rules), set(m.aggregations)]
    if len(set().union(*groups)) != sum(map(len, groups)) and m.flags:
        raise MetricError(f"{m.name} v{m.version}: a name is defined twice")
    known: set[str] = set()
    for name, text in m.flags.items():
        used = check_expression(spark, text, aggregate=False)
        if later := (used & set(m.flags)) - known:
            raise MetricError(f"{m.name} v{m.version}: {sorted(later)} used before it is defined")
        known.add(name)
    for text in m.aggregations.values():
        check_expression(spark, text, aggregate=True)


def with_flags(fact: DataFrame, m: Metric) -> DataFrame:
    """The fact with the metric's flags, never NULL. One projection per flag; Catalyst collapses them."""
    out = fact.select("*", *[F.lit(v).alias(k) for k, v in m.params.items()])
    for name, text in m.flags.items():
        out = out.select("*", F.coalesce(F.expr(safe_division(text)), F.lit(False)).alias(name))
    return out.drop(*m.params)


def columns_read(spark: SparkSession, m: Metric) -> set[str]:
    """Every fact column the definition reads."""
    names = {*m.key, m.period, *m.dimensions}
    for text in m.flags.values():
        names |= check_expression(spark, text, aggregate=False)
    for text in m.aggregations.values():
        names |= check_expression(spark, text, aggregate=True)
    return names - set(m.params) - set(m.flags)


def row_view(fact: DataFrame, m: Metric) -> DataFrame:
    """Key, period, dimensions, aggregated columns and flags: what consumers may read per line."""
    aggregated = set()
    for text in m.aggregations.values():
        aggregated |= check_expression(fact.sparkSession, text, aggregate=True)
    extra = sorted(aggregated - set(m.flags) - set(m.key) - set(m.dimensions))
    return with_flags(fact, m).select(*m.key, F.col(m.period).alias("metric_date"), *m.dimensions, *extra, *m.flags)


_SQL_TOKEN = re.compile(r"""--[^\n]*|/\*.*?\*/|\s+                                    # comments and space
    |'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`                      # literals and quoted names
    |(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\w*|\w+|::|.""", re.S | re.X)  # numbers, names, signs
_OPEN, _CLOSE = {"(": ")", "[": "]", "case": "end"}, {")", "]", "end"}


def _closed(tokens: list[str], at: int) -> int:
    """The place after what the bracket or CASE at `at` encloses."""
    depth = 0
    while at < len(tokens):
        depth += (tokens[at].lower() in _OPEN) - (tokens[at].lower() in _CLOSE)
        at += 1
        if not depth:
            break
    return at


def _operand(tokens: list[str], at: int) -> int:
    """The place after the operand that begins at `at`: signs, one thing, and what hangs on it."""
    blank = lambda t: t.isspace() or t.startswith(("--", "/*"))
    while at < len(tokens) and (blank(tokens[at]) or tokens[at] in "+-~"):
        at += 1
    at = _closed(tokens, at) if at < len(tokens) and tokens[at].lower() in _OPEN else at + 1
    while at < len(tokens):
        after = at
        while after < len(tokens) and blank(tokens[after]):
            after += 1
        if after < len(tokens) and tokens[after] in ("(", "["):
            at = _closed(tokens, after)
        elif after < len(tokens) and tokens[after] in (".", "::"):
            at = _operand(tokens, after + 1)
        else:
            break
    return at


def safe_division(text: str) -> str:
    """An expression whose every divisor is a double that is NULL instead of 0, at any depth, so x / 0 is NULL. Literals, quoted
    names and comments stay as they are."""
    def rewritten(tokens: list[str]) -> str:
        out, at = [], 0
        while at < len(tokens):
            out.append(tokens[at])
            at += 1
            if out[-1] == "/":
                end = _operand(tokens, at)
                out.append(f" nullif(cast(({rewritten(tokens[at:end])}\n) as double), 0e0)")  # a line comment ends here
                at = end
        return "".join(out)

    return rewritten(_SQL_TOKEN.findall(text))


def aggregate(fact: DataFrame, m: Metric, group_by: Sequence[str]) -> DataFrame:
    """Aggregations by periods (day, month) and declared dimensions; flags count as 0/1, x/0 is NULL."""
    periods = {"day": F.col(m.period), "month": F.date_format(m.period, "yyyy-MM")}
    groups = []
    for g in group_by:
        if g not in periods and g not in m.dimensions:
            raise MetricError(f"{m.name} v{m.version}: cannot group by {g!r}")
        groups.append(periods[g].alias(g) if g in periods else F.col(g))
    flagged = with_flags(fact, m)
    numeric = [F.col(f).cast("int").alias(f) for f in m.flags]
    keep = [c for c in flagged.columns if c not in m.flags]
    return (flagged.select(*keep, *numeric).groupBy(*groups)
            .agg(*[F.expr(safe_division(t)).alias(n) for n, t in m.aggregations.items()]))


def consumer(fact: DataFrame, name: str) -> DataFrame:
    metric, version, group_by = CONSUMERS[name]
    return aggregate(fact, BY_VERSION[(metric, version)], group_by)


def register_views(fact: DataFrame) -> list[str]:
    """Row views and consumer views as temporary views of the session."""
    for m in METRICS:
        row_view(fact, m).createOrReplaceTempView(m.view)
    for name in CONSUMERS:
        consumer(fact, name).createOrReplaceTempView(name)
    return [*[m.view for m in METRICS], *CONSUMERS]
