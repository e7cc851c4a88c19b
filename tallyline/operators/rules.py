"""The twelve validation rules, evaluated together in one pass over enriched lines.

A rule is a condition and an evidence struct. Nothing is changed or dropped: a violated rule becomes one
exception row. All look-ups are joins onto the lines (three masters and the repeated keys), after which every
rule is an expression in the same projection, so the lines are read once however many rules run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.joins import lookup
from tallyline.functions.text import fill, quoted_list, quoted_map, strip
from tallyline.schema import FieldDictionary

# Rule id -> severity, owner ('' = the line's source), message and suggested fix.
CATALOG: dict[str, tuple[str, str, str, str]] = {
    "V001": ("block", "", "Required field(s) blank: {missing}",
             "Ask the plant to resend the line with the missing field(s) filled"),
    "V002": ("block", "",
             "Issue date before order date, or confirmed delivery more than 30 days before the requested date",
             "Check the dates with the plant; a reversed issue date usually means a keying error"),
    "V003": ("block", "", "Invoiced weight outside [0, 105% of ordered weight]",
             "Confirm the invoiced weight against the scale ticket; do not invoice above tolerance"),
    "V004": ("block", "master_data:customers", "Customer {customer_no} is not in the customer master",
             "Correct the customer number at source, or have master data add the customer"),
    "V005": ("block", "master_data:items", "Item {item_no} is not in the item master",
             "Correct the item number at source, or have master data add the item"),
    "V006": ("block", "quality", "Lot {lot_no}: {problem}",
             "Hold the shipment record; quality to confirm the lot and expiry before it is reported"),
    "V007": ("block", "", "Negative ordered or invoiced quantity",
             "Returns and credits are not order lines; ask the plant to correct or reclassify the line"),
    "V008": ("block", "", "Order line {order_no}|{line_no} already appears in this batch at row {first_row}",
             "Discard the repeated line after confirming it is identical to the first"),
    "V009": ("warn", "", "UOM {uom} differs from item master basis {master_uom}",
             "Weights look recorded in {likely_unit}: convert to lb and set UOM to {master_uom}, keeping the "
             "original"),
    "V010": ("block", "", "Value(s) did not parse: {unparsed}",
             "Correct the value at source, or confirm a mapping with the right parser for this header"),
    "V011": ("warn", "", "Invoiced quantity with no positive ordered quantity",
             "Check whether the order line was changed after shipping"),
    "V012": ("block", "", "{reason}", "{fix}"),
}
WEIGHT_TOLERANCE = 1.05
EARLY_CONFIRM_DAYS = 30
KG_RATIO = (0.35, 0.6)
RULES = list(CATALOG)


@dataclass(frozen=True)
class Masters:
    """Master tables, one row per key: customers(customer_no), items(item_no, uom, avg_lb_per_case),
    lots(lot_no, expiry_date)."""

    customers: DataFrame
    items: DataFrame
    lots: DataFrame


def repeated_keys(silver: DataFrame) -> DataFrame:
    """Order lines that occur more than once in their batch, with the first row. Partial sums first, so a
    frequent key is folded before the shuffle, and only the repeated keys travel on."""
    keyed = silver.where(F.col("order_no").isNotNull() & F.col("line_no").isNotNull())
    return (keyed.groupBy("batch_id", "order_no", "line_no")
            .agg(F.min("source_row").alias("first_row"), F.count(F.lit(1)).alias("_n"))
            .where("_n > 1").drop("_n"))


def enrich(silver: DataFrame, masters: Masters, rules: Sequence[str] = RULES) -> DataFrame:
    """Lines with what the wanted rules look up. A look-up no wanted rule needs is left out."""
    wanted = set(rules)
    out = silver
    if "V004" in wanted:
        out = lookup(out, masters.customers.select("customer_no", F.lit(True).alias("_customer")),
                     "customer_no", ["batch_id", "source_row"])
    if wanted & {"V005", "V009"}:
        out = lookup(out, masters.items.select(
            "item_no", F.lit(True).alias("_item"), F.upper("uom").alias("_master_uom"),
            F.col("avg_lb_per_case").alias("_lb")), "item_no", ["batch_id", "source_row"])
    if "V006" in wanted:
        out = lookup(out, masters.lots.select(
            "lot_no", F.col("expiry_date").alias("_expiry")), "lot_no", ["batch_id", "source_row"])
    if "V008" in wanted:
        out = out.join(repeated_keys(silver), ["batch_id", "order_no", "line_no"], "left")
    return out


def _evidence(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _columns(*names: str) -> Column:
    return _evidence(**{n: F.col(n) for n in names})


def _unparsed(column: str) -> Column:
    return F.map_contains_key("parse_errors", F.lit(column))


def _supplied(column: str) -> Column:
    return F.array_contains("mapped", column)


def _verdict(rule: str, hit: Column, details: Column, values: dict[str, Column],
             severity: Column | None = None, owner: Column | None = None) -> Column:
    level, who, message, fix = CATALOG[rule]
    line = {c: F.col(c) for c in ("order_no", "line_no", "customer_no", "item_no", "uom", "lot_no")}
    slots = {**line, **values}
    default_owner = F.lit(who) if who else F.concat(F.lit("source:"), F.col("source"))
    return F.when(F.coalesce(hit, F.lit(False)), F.struct(
        F.lit(rule).alias("rule_id"), (severity if severity is not None else F.lit(level)).alias("severity"),
        (owner if owner is not None else default_owner).alias("owner"),
        fill(message, slots).alias("reason"), fill(fix, slots).alias("suggested_fix"),
        details.alias("details")))


def _v001(d: FieldDictionary) -> Column:
    missing = F.filter(F.array(*[F.when(F.col(c).isNull() & ~_unparsed(c), F.lit(c)) for c in d.always]),
                       lambda x: x.isNotNull())
    return _verdict("V001", F.size(missing) > 0, _evidence(missing=F.array_join(missing, ",")),
                    {"missing": quoted_list(missing)})


def _v002(_: FieldDictionary) -> Column:
    early = F.col("confirmed_delivery_date") < F.date_sub("requested_date", EARLY_CONFIRM_DAYS)
    reversed_ = F.col("issue_date") < F.col("order_date")
    return _verdict("V002", F.coalesce(reversed_, F.lit(False)) | F.coalesce(early, F.lit(False)),
                    _columns("order_date", "requested_date", "confirmed_delivery_date", "issue_date"), {})


def _v003(_: FieldDictionary) -> Column:
    invoiced, ordered = F.col("invoiced_weight_lb"), F.col("ordered_weight_lb")
    over = F.coalesce(invoiced > ordered * WEIGHT_TOLERANCE, F.lit(False))
    return _verdict("V003", F.coalesce(invoiced < 0, F.lit(False)) | over,
                    _columns("ordered_weight_lb", "invoiced_weight_lb"), {})


def _v004(_: FieldDictionary) -> Column:
    return _verdict("V004", F.col("customer_no").isNotNull() & F.col("_customer").isNull(),
                    _columns("customer_no"), {})


def _v005(_: FieldDictionary) -> Column:
    return _verdict("V005", F.col("item_no").isNotNull() & F.col("_item").isNull(), _columns("item_no"), {})


def _v006(_: FieldDictionary) -> Column:
    problem = (F.when(F.col("lot_no").isNull(), F.lit("lot number blank"))
               .when(F.col("_expiry").isNull(), F.lit("lot not in the lot master"))
               .when(F.col("issue_date") > F.col("_expiry"), F.lit("shipped after expiry")))
    return _verdict("V006", _supplied("lot_no") & problem.isNotNull(), _evidence(
        lot_no=F.col("lot_no"), problem=problem, expiry_date=F.col("_expiry"), issue_date=F.col("issue_date")),
        {"problem": problem})


def _v007(_: FieldDictionary) -> Column:
    return _verdict("V007", F.coalesce(F.col("ordered_qty") < 0, F.lit(False))
                    | F.coalesce(F.col("invoiced_qty") < 0, F.lit(False)),
                    _columns("ordered_qty", "invoiced_qty"), {})


def _v008(_: FieldDictionary) -> Column:
    return _verdict("V008", F.col("source_row") > F.col("first_row"),
                    _columns("order_no", "line_no", "first_row"), {"first_row": F.col("first_row")})


def _v009(_: FieldDictionary) -> Column:
    expected = F.col("ordered_qty") * F.col("_lb")
    ratio = F.try_divide(F.col("ordered_weight_lb"), expected)
    likely = F.when((ratio > KG_RATIO[0]) & (ratio < KG_RATIO[1]), F.lit("kg")).otherwise(F.lit("an unknown unit"))
    return _verdict("V009", F.upper(strip(F.col("uom"))) != F.col("_master_uom"), _evidence(
        uom=F.col("uom"), master_uom=F.col("_master_uom"), item_no=F.col("item_no"),
        weight_to_expected_lb_ratio=F.bround(ratio, 3), likely_unit=likely),
        {"master_uom": F.col("_master_uom"), "likely_unit": likely})


def _v010(_: FieldDictionary) -> Column:
    return _verdict("V010", F.size("parse_errors") > 0, F.col("parse_errors"),
                    {"unparsed": quoted_map(F.col("parse_errors"))})


def _v011(_: FieldDictionary) -> Column:
    return _verdict("V011", (F.col("invoiced_qty") > 0) & (F.col("ordered_qty") <= 0),
                    _columns("ordered_qty", "invoiced_qty"), {})


def _v012(d: FieldDictionary) -> Column:
    """Dated requirements. A line on or after the date is blocked, one before it is a warning; the first block
    wins, without one the last warning."""
    if not d.dated:
        return F.lit(None).cast("struct<rule_id:string,severity:string,owner:string,reason:string,"
                                "suggested_fix:string,details:map<string,string>>")
    blocks, warns = [], []
    for r in d.dated:
        supplied, day = _supplied(r.column), F.col(r.by)
        lacking = F.when(supplied, F.col(r.column).isNull() & ~_unparsed(r.column)).otherwise(F.lit(True))
        start = F.lit(r.start.isoformat()).cast("date")
        how = F.when(supplied, F.lit("blank")).otherwise(F.lit("not in this source's extract"))
        for is_block, bucket in ((True, blocks), (False, warns)):
            reason = F.concat(F.lit(f"{r.column} required from {r.start} (field dictionary v{d.version}) is "), how) \
                if is_block else F.concat(F.lit(f"{r.column} not covered before {r.start}: "), how)
            bucket.append(_verdict(
                "V012", lacking & (day >= start if is_block else day < start), _evidence(
                    column=F.lit(r.column), required_from=F.lit(r.start.isoformat()), by=F.lit(r.by),
                    coverage=F.lit("required" if is_block else "not_covered"), in_extract=supplied,
                    dictionary_version=F.lit(d.version), **{r.by: day}),
                {"reason": reason, "fix": F.lit(r.fix if is_block else r.before)},
                severity=F.lit("block" if is_block else "warn"), owner=F.lit(r.owner or d.owner)))
    return F.coalesce(*blocks, *reversed(warns))


_BUILD = {"V001": _v001, "V002": _v002, "V003": _v003, "V004": _v004, "V005": _v005, "V006": _v006,
          "V007": _v007, "V008": _v008, "V009": _v009, "V010": _v010, "V011": _v011, "V012": _v012}


def violations(silver: DataFrame, masters: Masters, dictionary: FieldDictionary,
               rules: Sequence[str] = RULES) -> DataFrame:
    """Exception rows (long form) for the wanted rules.

    `silver` carries batch_id, source, source_row, the canonical columns, parse_errors MAP and mapped ARRAY (the
    canonical columns the batch's mapping supplies).
    """
    asked = ["lot_no", *(r.column for r in dictionary.dated)]  # of `mapped` only what a rule asks travels to the look-ups
    enriched = enrich(silver.withColumn("mapped", F.filter("mapped", lambda c: c.isin(*asked))), masters, rules)
    found = F.filter(F.array(*[_BUILD[r](dictionary) for r in rules]), lambda v: v.isNotNull())
    key = F.concat_ws("|", F.coalesce("order_no", F.lit("?")), F.coalesce(F.col("line_no").cast("string"),
                                                                         F.lit("?")))
    return (enriched.select("batch_id", "source", "source_row", key.alias("row_key"), found.alias("_found"))
            .select("batch_id", "source", "source_row", "row_key", F.explode("_found").alias("_v"))
            .select("batch_id", "source", "source_row", "row_key", "_v.*"))


def coverage(silver: DataFrame, found: DataFrame) -> DataFrame:
    """Rows validated per batch and violations per rule, rules without a violation included as zero."""
    rows = silver.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows_validated"))
    counts = found.groupBy("batch_id", "rule_id").agg(F.count(F.lit(1)).alias("violations"))
    every = rows.withColumn("rule_id", F.explode(F.array(*[F.lit(r) for r in RULES])))
    return (every.join(counts, ["batch_id", "rule_id"], "left")
            .withColumn("violations", F.coalesce("violations", F.lit(0).cast("bigint"))))
