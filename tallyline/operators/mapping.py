"""Heuristic column mapping: profile columns against canonical fields, assigned one to one.

The tables here are headers and fields (at most a few dozen columns per header), so the work is small whatever
the extracts hold; it still runs for all sources and headers in one job.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.schema import DATE_PARSERS, KIND, REQUIRED, TRANSFORMS, canonical_fields

# Python workers get these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME_WEIGHT = 0.55
MIN_SCORE = 0.45
CANONICAL_CUSTOMER_SHAPE = "A999999"
# Spellings of each concept, and the words that say nothing about a name.
SPELLINGS = {
    "order": ["order", "orders", "ord", "ordered"],
    "line": ["line", "ln", "lne"],
    "no": ["no", "num", "number", "nbr", "nr", "id"],
    "customer": ["customer", "cust", "cus", "client"],
    "item": ["item", "itm", "sku", "material", "product", "prod"],
    "plant": ["plant", "fac", "facility", "site"],
    "date": ["date", "dt"],
    "requested": ["requested", "request", "req", "wanted"],
    "confirmed": ["confirmed", "confirm", "cfm", "promise", "promised", "commit", "committed"],
    "delivery": ["delivery", "dlv", "deliv"],
    "issue": ["issue", "issued", "iss"],
    "ship": ["ship", "shipped", "shipping"],
    "invoiced": ["invoiced", "invoice", "inv"],
    "qty": ["qty", "quantity", "qnty"],
    "weight": ["weight", "wt", "wgt"],
    "uom": ["uom", "unit", "measure"],
    "lot": ["lot", "batch"],
}
IGNORED = ["of", "cd", "code", "kg", "kgs", "lb", "lbs"]
WORD = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"


def split_words(token: str, known: frozenset[str]) -> list[str]:
    """A run-together token as known words when they cover it whole (longest first), else the token itself."""
    best: dict[int, list[str] | None] = {len(token): []}
    for start in range(len(token) - 1, -1, -1):
        best[start] = None
        for end in range(len(token), start, -1):
            if token[start:end] in known and best.get(end) is not None:
                best[start] = [token[start:end], *best[end]]
                break
    return best[0] if token and best[0] is not None else [token]


@F.pandas_udf(T.ArrayType(T.StringType()))
def concepts(names: pd.Series) -> pd.Series:
    """Concepts a column name speaks of, sorted. Applied to distinct header names only."""
    meaning = {word: concept for concept, words in SPELLINGS.items() for word in words}
    known = frozenset(meaning) | frozenset(IGNORED)

    def of(name: str) -> list[str]:
        words = [w for token in re.findall(WORD, name) for w in split_words(token.lower(), known)]
        return sorted({meaning.get(w, w) for w in words if w not in IGNORED})

    return names.map(of)


def name_score(found: Column, groups: Column) -> Column:
    """Dice overlap of a name's concepts with a field's concept groups."""
    matched = F.size(F.filter(groups, lambda g: F.arrays_overlap(g, found)))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(2.0 * matched / (F.size(groups) + F.size(found)))


def evidence_score(kind: Column) -> Column:
    """0..1 from the column's profile alone; 0 rules the pair out."""
    dtype, ref = F.col("dtype"), F.col("master")
    distinct = F.col("distinct_pct")
    number, key = dtype.isin("decimal", "integer"), dtype.isin("string", "integer")
    free_text = ref.isNull() & (dtype == "string")
    has_unit = F.col("has_unit")
    top = F.col("max_value").try_cast("double")
    return (
        F.when(kind == "date", F.when(dtype == "date", 1.0).otherwise(0.0))
        .when(kind == "weight", F.when(~number, 0.0).when(has_unit, 1.0).otherwise(0.3))
        .when(kind == "qty", F.when(~number | has_unit, 0.0).when(dtype == "integer", 1.0).otherwise(0.6))
        .when(kind == "line", F.when((dtype == "integer") & (top < 1000) & ref.isNull(), 1.0).otherwise(0.0))
        .when(kind == "order_id", F.when(ref.isNotNull() | ~key, 0.0).when(distinct >= 5.0, 1.0).otherwise(0.2))
        .when(kind == "customer", F.when(ref == "customers", 1.0)
              .when(ref.isNotNull() | ~key | (distinct >= 5.0), 0.0).otherwise(0.7))
        .when(kind == "item", F.when(ref == "items", 1.0).when(free_text & (distinct < 5.0), 0.4).otherwise(0.0))
        .when(kind == "plant", F.when(ref == "plants", 1.0).when(free_text & (distinct < 0.1), 0.3).otherwise(0.0))
        .when(kind == "uom", F.when(free_text & (distinct < 1.0), 1.0).otherwise(0.0))
        .when(kind == "lot", F.when(free_text & (distinct >= 50.0), 1.0).otherwise(0.0))
        .otherwise(0.0))


def score_pairs(profile: DataFrame, headers: DataFrame) -> DataFrame:
    """Every (header column, canonical field) pair with name, evidence and total score.

    `headers`: source, header_hash, position, source_col. `profile`: source, column, dtype, date_format, null_pct,
    distinct_pct, whitespace_pct, max_value, master, trimmed_pct, unit, has_unit, top_shape. The field list is fixed.
    """
    names = headers.select("source_col").distinct().select("source_col", concepts("source_col").alias("found"))
    rows = headers.join(profile.withColumnRenamed("column", "source_col"), ["source", "source_col"]).join(
        names, "source_col")
    fields = canonical_fields(profile.sparkSession)
    name, evidence = name_score(F.col("found"), F.col("concepts")), evidence_score(F.col("kind"))
    return (rows.crossJoin(F.broadcast(fields))  # fifteen fixed rows
            .withColumns({"name_score": name, "evidence_score": evidence})
            .withColumn("score", NAME_WEIGHT * F.col("name_score") + (1 - NAME_WEIGHT) * F.col("evidence_score")))


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best pair first; a column and a field are used once. One header's pairs, at most columns x fields."""
    columns, fields, kept = set(), set(), []
    ranked = pdf.sort_values(["score", "position", "field_order"], ascending=[False, True, True])
    for row in ranked.itertuples(index=False):
        if row.source_col not in columns and row.canonical_col not in fields:
            columns.add(row.source_col)
            fields.add(row.canonical_col)
            kept.append(row)
    return pd.DataFrame(kept, columns=pdf.columns)


def assign(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment per header among pairs that score enough."""
    wanted = pairs.where((F.col("evidence_score") > 0) & (F.col("score") >= MIN_SCORE)).select(
        "source", "header_hash", "position", "source_col", "field_order", "canonical_col", "score", "name_score",
        "evidence_score")
    return wanted.groupBy("source", "header_hash").applyInPandas(_assign, wanted.schema)


def propose(profile: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per header column: the proposed field (NULL = unmapped), confidence, rationale and transforms."""
    chosen = assign(score_pairs(profile, headers)).drop("position", "field_order")
    rows = headers.join(chosen, ["source", "header_hash", "source_col"], "left").join(
        profile.withColumnRenamed("column", "source_col"), ["source", "source_col"], "left")
    kinds = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])
    kind = F.try_element_at(kinds, F.col("canonical_col"))
    parser = F.when(F.col("date_format") == "iso", "parse_date_iso").when(
        F.col("date_format") == "us", "parse_date_us").when(F.col("date_format") == "dmy", "parse_date_dmy").when(
        F.col("date_format") == "excel_serial", "parse_excel_serial")
    shape = F.coalesce("top_shape", F.lit(""))
    steps = F.filter(F.array(
        F.when(F.col("whitespace_pct") > 0, "trim"), F.when(kind == "date", parser),
        F.when((kind == "weight") & (F.col("unit") == "kg"), "kg_to_lb"),
        F.when((kind == "customer") & (shape != CANONICAL_CUSTOMER_SHAPE), "normalize_customer_no")),
        lambda t: t.isNotNull())
    two = lambda c: F.format_string("%.2f", c)
    why = F.concat(
        F.lit("→ "), F.col("canonical_col"), F.lit(": name "), two(F.col("name_score")), F.lit("; evidence "),
        two(F.col("evidence_score")), F.lit(" ("), F.col("dtype"),
        F.coalesce(F.concat(F.lit(", "), F.col("trimmed_pct").cast("string"), F.lit("% in "), F.col("master"),
                            F.lit(" master")), F.lit("")),
        F.coalesce(F.concat(F.lit(", "), F.col("unit")), F.lit("")),
        F.coalesce(F.concat(F.lit(", "), F.col("date_format"), F.lit(" dates")), F.lit("")), F.lit(")"))
    mapped = F.col("canonical_col").isNotNull()
    return rows.select(
        "source", "header_hash", "position", "source_col", "canonical_col",
        F.when(mapped, F.bround("score", 3)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(mapped, why).otherwise(F.lit("no canonical column scored above the threshold")).alias("rationale"),
        F.when(mapped, steps).otherwise(F.array().cast("array<string>")).alias("transforms"))


def header_hash(columns: Column) -> Column:
    """Order-sensitive: a reordered extract is a different header."""
    return F.sha2(F.to_json(columns), 256)


def contract_violations(mappings: DataFrame, headers: DataFrame) -> DataFrame:
    """What breaks the mapping contract (mapping_id, problem, subject); no row means the mapping is acceptable.

    `mappings`: mapping_id, source_col, canonical_col, transforms. `headers`: mapping_id, source_col (the file's).
    """
    kinds = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])
    m = mappings.withColumn("kind", F.try_element_at(kinds, F.col("canonical_col")))
    known = F.col("canonical_col").isin(*KIND)
    parsers = F.size(F.array_intersect("transforms", F.array(*map(F.lit, DATE_PARSERS))))
    odd = F.array_except("transforms", F.array(*map(F.lit, TRANSFORMS)))
    has = lambda t: F.array_contains("transforms", t)
    checks = F.filter(F.array(
        F.when(F.col("canonical_col").isNotNull() & ~known, F.lit("unknown canonical column")),
        F.when(F.size(odd) > 0, F.lit("unknown transform")),
        F.when(F.col("canonical_col").isNull() & (F.size("transforms") > 0),
               F.lit("an unmapped column cannot carry transforms")),
        F.when((F.col("kind") == "date") & (parsers != 1), F.lit("a date column needs exactly one date parser")),
        F.when((F.col("kind") != "date") & (parsers > 0), F.lit("date parser on a column that is no date")),
        F.when((F.col("kind") != "weight") & has("kg_to_lb"), F.lit("kg_to_lb only applies to weights")),
        F.when((F.col("kind") != "customer") & has("normalize_customer_no"),
               F.lit("normalize_customer_no only applies to the customer number"))), lambda c: c.isNotNull())
    per_column = m.select("mapping_id", F.explode(checks).alias("problem"), F.col("source_col").alias("subject"))
    listed = mappings.groupBy("mapping_id", "source_col").agg(F.count(F.lit(1)).alias("n"))
    j = listed.join(headers.select("mapping_id", "source_col", F.lit(True).alias("in_file")),
                    ["mapping_id", "source_col"], "full")
    cover = j.select("mapping_id", F.col("source_col").alias("subject"), F.when(
        F.col("n").isNull(), "header column missing").when(F.col("in_file").isNull(), "not in the header").when(
        F.col("n") > 1, "header column listed more than once").alias("problem")).where("problem is not null")
    twice = mappings.where("canonical_col is not null").groupBy(
        "mapping_id", F.col("canonical_col").alias("subject")).count().where("count > 1").select(
        "mapping_id", F.lit("canonical column mapped more than once").alias("problem"), "subject")
    return per_column.unionByName(cover).unionByName(twice)


def unmapped_required(mappings: DataFrame) -> DataFrame:
    """Required fields a mapping does not supply, in name order."""
    have = mappings.groupBy("mapping_id").agg(F.collect_set("canonical_col").alias("_have"))
    return have.select("mapping_id", F.array_sort(F.array_except(
        F.array(*map(F.lit, REQUIRED)), "_have")).alias("missing"))


def lifecycle(versions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mapping versions after confirm/reject decisions (mapping_version_id, decision_id, action).

    A version is decided once (its first decision); a confirmation needs every required field mapped; the latest
    confirmed version of a header supersedes the earlier ones. `versions` carries unmapped_required (count).
    """
    first = decisions.groupBy("mapping_version_id").agg(
        F.min_by("action", "decision_id").alias("_action"), F.min("decision_id").alias("_at"))
    j = versions.join(first, "mapping_version_id", "left")
    accepted = (F.col("status") == "proposed") & (F.col("_action") == "confirm") & (F.col("unmapped_required") == 0)
    rejected = (F.col("status") == "proposed") & (F.col("_action") == "reject")
    after = j.withColumn("_status", F.when(accepted, "confirmed").when(rejected, "rejected").otherwise(F.col("status")))
    # versions confirmed before this run rank behind those the decisions confirm
    rank = F.when(F.col("_status") == "confirmed", F.when(accepted, F.col("_at")).otherwise(F.lit(-1).cast("bigint")))
    best = after.withColumn("_rank", rank).groupBy("source", "header_hash").agg(F.max("_rank").alias("_best"))
    out = after.withColumn("_rank", rank).join(best, ["source", "header_hash"], "left")
    return out.withColumn("status", F.when(
        (F.col("_status") == "confirmed") & (F.col("_rank") < F.col("_best")), "superseded")
        .otherwise(F.col("_status"))).drop("_status", "_rank", "_best", "_action", "_at")


def number_versions(existing: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals not already live, numbered on from each source's highest version (proposal order)."""
    from pyspark.sql import Window

    live = existing.where(F.col("status").isin("proposed", "confirmed"))
    same = ["source", "header_hash", "proposed_by", "mapping_key"]
    fresh = proposals.join(live.select(*same), same, "left_anti")
    top = existing.groupBy("source").agg(F.max("version").alias("_top"))
    order = Window.partitionBy("source").orderBy("proposal_order")
    return fresh.join(top, "source", "left").withColumn(
        "version", F.coalesce("_top", F.lit(0)) + F.row_number().over(order)).drop("_top")
