"""Profiling of raw text extracts, before any mapping exists.

Everything is derived from one value table: (source, file, column, value) with its count. Counting values first
means a column's cells are folded map-side, and every later statistic (types by majority, shapes, distinct
shares, master matches, ranges) is a weighted aggregate over distinct values.

Cells enter as `cells`: batch_id, source, column, position, value (text, '' when blank).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.text import shape, strip
from tallyline.schema import LB_PER_KG

# Patterns, shares and ranges the classification uses.
ISO = r"^\d{4}-\d{2}-\d{2}$"
SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
DASHED = r"^[+-]?\d+-\d+-\d+$"  # all that yyyy-MM-dd, and M/d/yyyy or d/M/yyyy, can be read from
STROKED = r"^[+-]?\d+/[+-]?\d+/[+-]?\d+$"
INTEGER = r"^-?\d+(?:\.0+)?$"
DECIMAL = r"^-?\d+(?:\.\d+)?$"
MATCH_SHARE = 0.98
MASTER_SHARE_PCT = 90.0 * MATCH_SHARE
SERIALS = (36526, 55153)
TOP_SHAPES = 3
UNIT_TOLERANCE = 0.15
MIN_RATIOS = 30
KEY_MAX_DUPLICATE_PCT = 2.0
RARE_SHAPE_PCT = 5.0
KG_WORDS = ["kg", "kgs", "kilo", "kilos", "kilogram", "kilograms"]
LB_WORDS = ["lb", "lbs", "pound", "pounds"]
WORD = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"


def pct(part: Column, whole: Column) -> Column:
    """Share in percent at three decimals, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(100.0 * part / whole, 3))


def cells(bronze: DataFrame) -> DataFrame:
    """One row per cell of the bronze records (batch_id, source, source_row, record)."""
    at = F.struct("batch_id", "source_row").alias("at")
    return bronze.select("batch_id", "source", at, F.explode("record").alias("column", "value"))


def value_counts(cells_: DataFrame, by: Sequence[str]) -> DataFrame:
    """How often each value occurs per column, within `by` (source, or source and batch). A count alone folds by hash; with a
    text or struct beside it every cell would be sorted."""
    return cells_.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def _weighted(flag: Column) -> Column:
    return F.sum(F.when(flag, F.col("n")).otherwise(0))


def weighted_cells(cells_: DataFrame) -> DataFrame:
    """Cells as value counts of one each, for statistics that fold in the sending task without being counted first."""
    return cells_.withColumn("n", F.lit(1).cast("bigint"))


def column_stats(counts: DataFrame, by: Sequence[str], distinct: bool = True) -> DataFrame:
    """Per column: type, date format, blank, distinct and white-space shares, negatives and numeric range.

    All but the number of distinct values are sums and extremes, which a task folds to one row per column before it sends
    anything; so `counts` may be value counts or single cells. Each distinct text is sent once, or not at all without
    `distinct`, where the result has no distinct_pct.
    """
    text = F.col("_text")
    v = counts.select(*by, "column", "value", "n", strip(F.col("value")).alias("_text"))
    # a text without the mark of a pattern cannot match it, and is neither searched nor parsed
    marked = lambda mark, form: F.contains(text, F.lit(mark)) & text.rlike(form)
    v = v.withColumns({"_filled": text != "", "_dash": marked("-", DASHED), "_stroke": marked("/", STROKED), "_number": text.rlike(DECIMAL)})
    v = v.withColumns({"_num": F.when(F.col("_number"), text.try_cast("double")), "_is_int": F.col("_filled") & F.col("_number") & text.rlike(
        INTEGER), "_is_iso": F.col("_dash") & text.rlike(ISO), "_is_slash": F.col("_stroke") & text.rlike(SLASH)})
    f, is_int = F.col("_filled"), F.col("_is_int")
    part = lambda i: F.max(F.when(F.col("_is_slash"), F.regexp_extract(text, SLASH, i).try_cast("int")))
    dated = lambda mark, form: _weighted(f & F.col(mark) & F.when(F.col(mark), F.try_to_date(text, form)).isNotNull())
    folded = v.groupBy(*by, "column").agg(
        F.sum("n").alias("rows"), _weighted(f).alias("filled"), _weighted(f & (text != F.col("value"))).alias("padded"),
        _weighted(f & F.col("_is_iso")).alias("_iso"), _weighted(f & F.col("_is_slash")).alias("_slash"),
        part(1).alias("_first"), part(2).alias("_second"),
        _weighted(is_int).alias("_int"), _weighted(is_int & F.col("_num").between(*SERIALS)).alias("_serial"),
        _weighted(f & F.col("_num").isNotNull()).alias("_decimal"),
        _weighted(f & (F.col("_num") < 0)).alias("_negative"),
        F.min(F.when(f, F.col("_num"))).alias("_min"), F.max(F.when(f, F.col("_num"))).alias("_max"),
        dated("_dash", "yyyy-MM-dd").alias("_iso_ok"), dated("_stroke", "M/d/yyyy").alias("_us_ok"),
        dated("_stroke", "d/M/yyyy").alias("_dmy_ok"))
    g = folded
    if distinct:
        # blank cells must not count as one distinct value; put beside the sums by a union, so that NULL keys meet
        texts = v.where(f).select(*by, "column", "_text").distinct().groupBy(*by, "column").agg(
            F.count(F.lit(1)).alias("distinct_values"))
        both = folded.unionByName(texts, allowMissingColumns=True)
        g = both.groupBy(*by, "column").agg(*[F.max(c).alias(c) for c in both.columns if c not in (*by, "column")]).withColumn(
            "distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint")))
    share = lambda c: F.when(F.col("filled") == 0, F.lit(0.0)).otherwise(F.col(c) / F.col("filled"))
    big = lambda c: F.coalesce(F.col(c) > 12, F.lit(False))
    slash_format = F.when(big("_second") & ~big("_first"), "us").when(big("_first") & ~big("_second"), "dmy") \
        .otherwise("slash_ambiguous")
    date_format = F.when(F.col("filled") == 0, F.lit(None)).when(share("_iso") >= MATCH_SHARE, "iso") \
        .when(share("_slash") >= MATCH_SHARE, slash_format) \
        .when((share("_int") >= MATCH_SHARE) & (share("_serial") >= MATCH_SHARE), "excel_serial")
    dtype = F.when(F.col("filled") == 0, "empty").when(F.col("date_format").isNotNull(), "date") \
        .when(share("_int") >= MATCH_SHARE, "integer").when(share("_decimal") >= MATCH_SHARE, "decimal") \
        .otherwise("string")
    ok = F.when(F.col("date_format") == "iso", F.col("_iso_ok")).when(
        F.col("date_format") == "dmy", F.col("_dmy_ok")).when(
        F.col("date_format") == "excel_serial", F.col("_serial")).otherwise(F.col("_us_ok"))
    numeric = F.col("dtype").isin("integer", "decimal")
    show = lambda c: F.when(numeric, F.when(F.col("dtype") == "integer", F.col(c).cast("bigint").cast("string"))
                            .otherwise(F.col(c).cast("string")))
    return (g.withColumn("date_format", date_format).withColumn("dtype", dtype).select(
        *by, "column", "rows", "filled", "dtype", "date_format",
        F.when(F.col("date_format").isNotNull(), pct(ok, F.col("filled"))).alias("parsed_pct"),
        pct(F.col("rows") - F.col("filled"), F.col("rows")).alias("null_pct"),
        *([pct(F.col("distinct_values"), F.col("filled")).alias("distinct_pct")] if distinct else []),
        pct(F.col("padded"), F.col("filled")).alias("whitespace_pct"),
        F.when(numeric, F.col("_negative")).alias("negative_count"),
        show("_min").alias("min_value"), show("_max").alias("max_value")))


def files_present(cells_: DataFrame) -> DataFrame:
    return cells_.groupBy("source", "column").agg(F.count_distinct("batch_id").alias("present_in_files"))


def top_shapes(counts: DataFrame, by: Sequence[str], k: int = TOP_SHAPES, cells_: DataFrame | None = None) -> DataFrame:
    """The most frequent value shapes per column (count, then shape); with `cells_` each with the first value of that shape."""
    v = counts.where(strip(F.col("value")) != "").withColumn("shape", shape(F.col("value")))
    g = v.groupBy(*by, "column", "shape").agg(F.sum("n").alias("n"))
    totals = g.groupBy(*by, "column").agg(F.sum("n").alias("_total"))
    rank = Window.partitionBy(*by, "column").orderBy(F.desc("n"), "shape")
    ranked = g.withColumn("position", F.row_number().over(rank)).where(F.col("position") <= k)
    out = ranked.join(totals, [*by, "column"])
    kept = [*by, "column", "position", "shape", pct(F.col("n"), F.col("_total")).alias("share_pct")]
    if cells_ is None:
        return out.select(*kept)
    return out.join(first_values(cells_, by), [*by, "column", "shape"]).select(*kept, "example")


def first_values(cells_: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first value (batch, then row) of each shape of a column. Shapes are counted by batch first, which folds by hash; the
    rows of a shape's first batch alone are compared. A row without a batch comes before all batches."""
    batch = F.coalesce(F.concat(F.lit("="), F.col("at.batch_id")), F.lit(""))
    shaped = cells_.where(strip(F.col("value")) != "").select(*by, "column", shape(F.col("value")).alias("shape"), "at", "value")
    key = [*by, "column", "shape"]
    first = shaped.groupBy(*key, batch.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).groupBy(*key).agg(
        F.min("_b").alias("_b"))
    marked = shaped.withColumn("_b", batch).join(first, [*key, "_b"])
    return marked.groupBy(*key).agg(F.min_by("value", "at").alias("example"))


def master_match(counts: DataFrame, masters: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """The master (master, key) that covers most of a column after trimming, if it covers enough of it."""
    v = counts.where(strip(F.col("value")) != "").withColumn("key", strip(F.col("value")))
    totals = v.groupBy(*by, "column").agg(F.sum("n").alias("_total"))
    hit = v.join(masters, "key").groupBy(*by, "column", "master").agg(
        F.sum("n").alias("_trimmed"),
        F.sum(F.when(F.col("value") == F.col("key"), F.col("n")).otherwise(0)).alias("_exact"))
    scored = hit.join(totals, [*by, "column"]).select(
        *by, "column", "master", pct(F.col("_exact"), F.col("_total")).alias("exact_pct"),
        pct(F.col("_trimmed"), F.col("_total")).alias("trimmed_pct")).where(F.col("trimmed_pct") >= MASTER_SHARE_PCT)
    best = Window.partitionBy(*by, "column").orderBy(F.desc("trimmed_pct"), "master")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


# ---- units ---------------------------------------------------------------------------------------------------

def exact_median(df: DataFrame, keys: Sequence[str], value: str, store: Callable[[DataFrame], DataFrame] = lambda df: df
                 ) -> DataFrame:
    """Exact median of a positive column per group without gathering a group.

    Two rounds of order-preserving buckets (powers of two in 64 steps, then 4,096 equal steps inside the bucket)
    find the cells that hold the middle ranks; only those cells' distinct values are then ordered. Repeated
    values are counted, not repeated. `store` writes the counted values and reads them back, as every round starts there.
    """
    keys = list(keys)
    counted = store(df.where(F.col(value) > 0).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))

    def narrow(data: DataFrame, cell: Column, marks: DataFrame | None) -> DataFrame:
        celled = data.withColumn("_cell", cell)
        sizes = celled.groupBy(*keys, "_cell").agg(F.sum("n").alias("_size"), F.min(value).alias("_lo"),
                                                   F.max(value).alias("_hi"))
        run = Window.partitionBy(*keys).orderBy("_cell")
        placed = sizes.withColumn("_end", F.sum("_size").over(run)).withColumn("_start", F.col("_end") - F.col("_size"))
        if marks is None:
            totals = sizes.groupBy(*keys).agg(F.sum("_size").alias("_n"))
            placed = placed.join(totals, keys).withColumn("_below", F.lit(0).cast("bigint"))
        else:
            placed = placed.join(marks, keys)
        # ranks of the one or two middle values, counted from 1 over the whole group
        lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
        start, end = F.col("_start") + F.col("_below"), F.col("_end") + F.col("_below")
        keep = placed.where((start < hi) & (end >= lo))
        span = keep.groupBy(*keys).agg(
            F.first("_n").alias("_n"), F.min(F.col("_start") + F.col("_below")).alias("_below"),
            F.min("_lo").alias("_from"), F.max("_hi").alias("_to"))
        return span

    first = narrow(counted, F.floor(F.log2(F.col(value)) * 64), None)
    inside = counted.join(first, keys).where(F.col(value).between(F.col("_from"), F.col("_to")))
    step = F.when(F.col("_to") > F.col("_from"),
                  F.floor((F.col(value) - F.col("_from")) / (F.col("_to") - F.col("_from")) * 4096)).otherwise(0)
    second = narrow(inside.select(*keys, value, "n", "_from", "_to"), step, first.select(*keys, "_n", "_below"))
    last = counted.join(second, keys).where(F.col(value).between(F.col("_from"), F.col("_to")))
    run = Window.partitionBy(*keys).orderBy(value)
    placed = last.withColumn("_end", F.sum("n").over(run) + F.col("_below")).withColumn(
        "_start", F.col("_end") - F.col("n"))
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    at = lambda r: F.max(F.when((F.col("_start") < r) & (F.col("_end") >= r), F.col(value)))
    return placed.groupBy(*keys).agg(((at(lo) + at(hi)) / 2).alias("median"), F.first("_n").alias("points"))


def unit_ratios(pairs: DataFrame, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Per weight column: the quantity column whose ratio value / (qty x lb per case) looks most like a unit.

    `pairs` carries source, column, qty_column and ratio (positive). Needs at least thirty ratios.
    """
    medians = exact_median(pairs, ["source", "column", "qty_column"], "ratio", store).where(F.col("points") >= MIN_RATIOS)
    distance = F.least(F.abs(F.ln("median")), F.abs(F.ln(F.col("median") * LB_PER_KG)))
    best = Window.partitionBy("source", "column").orderBy("_distance", "qty_column")
    return (medians.withColumn("_distance", distance).withColumn("_r", F.row_number().over(best)).where("_r = 1")
            .select("source", "column", "qty_column", F.bround("median", 4).alias("ratio")))


def header_unit(name: Column) -> Column:
    words = F.transform(F.regexp_extract_all(name, F.lit(WORD), F.lit(0)), F.lower)
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, KG_WORDS))), "kg").when(
        F.arrays_overlap(words, F.array(*map(F.lit, LB_WORDS))), "lb")


def units(stats: DataFrame, ratios: DataFrame) -> DataFrame:
    """Unit of each decimal column from its header and from its magnitude; a conflict leaves it open."""
    near = lambda r: F.abs(F.ln(r)) <= UNIT_TOLERANCE
    j = stats.where("dtype = 'decimal'").select("source", "column").join(
        ratios.select("source", "column", "ratio"), ["source", "column"], "left")
    magnitude = F.when(near(F.col("ratio")), "lb").when(near(F.col("ratio") * LB_PER_KG), "kg")
    u = j.withColumn("header_unit", header_unit(F.col("column"))).withColumn("magnitude_unit", magnitude)
    conflict = F.coalesce(F.col("header_unit") != F.col("magnitude_unit"), F.lit(False))
    return u.withColumn("conflict", conflict).withColumn(
        "unit", F.when(~F.col("conflict"), F.coalesce("header_unit", "magnitude_unit"))).where(
        "header_unit is not null or magnitude_unit is not null")


# ---- keys and duplicates -------------------------------------------------------------------------------------

def candidate_key(bronze: DataFrame, stats: DataFrame, positions: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per source the one or two columns with the fewest duplicate rows, at most two percent.

    A pair can only be that unique if the product of its columns' distinct counts is; pairs that fail this bound
    are dropped before any of them is counted, which is exact and leaves few. The rest are counted in one pass.
    `positions` (source, column, position) breaks ties: fewer columns first, then the earlier ones. `counts` are the value
    counts by source, where they are at hand.
    """
    cell = lambda r, c: F.coalesce(strip(F.try_element_at(r, c)), F.lit("\u0000"))
    none = F.lit("").alias("b")

    def uniqueness(keyed: DataFrame) -> DataFrame:
        return keyed.groupBy("source", "a", "b", "key").agg(F.count(F.lit(1)).alias("n")).groupBy(
            "source", "a", "b").agg(F.count(F.lit(1)).alias("distinct_keys"), F.sum("n").alias("rows"))

    if counts is None:
        counts = value_counts(cells(bronze), ["source"])
    # a column's own keys are its distinct texts, and one more where a record lacks it
    total = bronze.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    near = stats.where(F.col("dtype").isin("string", "integer") & (F.col("null_pct") < 1.0)).select("source", "column")
    texts = counts.join(near, ["source", "column"]).where("value is not null").groupBy("source", "column", strip(
        F.col("value")).alias("_text")).agg(F.sum("n").alias("n"))
    ones = texts.groupBy("source", F.col("column").alias("a")).agg(F.count(F.lit(1)).alias("_d"), F.sum("n").alias("_n")).join(
        total, "source").select("source", "a", none, (F.col("_d") + F.when(F.col("_n") < F.col("rows"), 1).otherwise(0)).alias(
            "distinct_keys"), "rows")
    left = ones.select("source", "a", F.col("distinct_keys").alias("_da"), "rows")
    right = ones.select("source", F.col("a").alias("b"), F.col("distinct_keys").alias("_db"))
    worth = left.join(right, "source").where(
        (F.col("a") < F.col("b")) & (F.col("_da").cast("double") * F.col("_db") >= 0.97 * F.col("rows")))
    wanted = worth.groupBy("source").agg(F.collect_set(F.struct("a", "b")).alias("_wanted"))
    pairs = bronze.join(wanted, "source").select("source", F.explode(F.transform(
        "_wanted", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.concat(
            cell(F.col("record"), p["a"]), F.lit("\u0001"), cell(F.col("record"), p["b"])).alias("key")))).alias("_k"))
    scored = ones.unionByName(uniqueness(pairs.select("source", "_k.*")))
    at = lambda side, name: positions.select("source", F.col("column").alias(side), F.col("position").alias(name))
    scored = (scored.withColumn("duplicate_rows", F.col("rows") - F.col("distinct_keys"))
              .withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("rows")))
              .where(F.col("duplicate_pct") <= KEY_MAX_DUPLICATE_PCT)
              .join(at("a", "_pa"), ["source", "a"], "left").join(at("b", "_pb"), ["source", "b"], "left"))
    # a pair reads in file order whatever the name order
    first, second = F.least("_pa", F.coalesce("_pb", "_pa")), F.greatest("_pa", F.coalesce("_pb", "_pa"))
    label = F.when(F.col("b") == "", F.col("a")).when(F.col("_pa") < F.col("_pb"), F.concat_ws(",", "a", "b")) \
        .otherwise(F.concat_ws(",", "b", "a"))
    return scored.groupBy("source").agg(F.min_by(F.struct(
        label.alias("key_columns"), "duplicate_rows", "duplicate_pct"), F.struct(
        "duplicate_rows", F.when(F.col("b") == "", 0).otherwise(1), first, second)).alias("_k")).select("source", "_k.*")


def exact_duplicates(bronze: DataFrame) -> DataFrame:
    """Rows per source that repeat an earlier row in every column; an absent column equals a blank one."""
    row = F.array_sort(F.map_entries(F.map_filter("record", lambda _, v: v != "")))
    return bronze.groupBy("source", row.alias("_row")).agg(F.count(F.lit(1)).alias("_n")).groupBy("source").agg(
        F.sum(F.col("_n") - 1).alias("exact_duplicate_rows"))


def headers_of(bronze: DataFrame) -> DataFrame:
    """Each extract's ordered header, read off its records."""
    return bronze.groupBy("source", "batch_id").agg(F.any_value(F.map_keys("record")).alias("columns"))


def ratio_pairs(bronze: DataFrame, stats: DataFrame, matches: DataFrame, items: DataFrame) -> DataFrame:
    """value / (quantity x lb per case) for every decimal column and every integer column no master explains."""
    item_col = matches.where("master = 'items'").groupBy("source").agg(F.min("column").alias("_item"))
    ints = stats.where("dtype = 'integer'").join(matches.select("source", "column"), ["source", "column"], "left_anti")
    pairs = stats.where("dtype = 'decimal'").select("source", "column").join(
        ints.select("source", F.col("column").alias("qty_column")), "source").groupBy("source").agg(
        F.collect_list(F.struct("column", "qty_column")).alias("_pairs"))
    wide = bronze.join(pairs, "source").join(item_col, "source")
    keyed = wide.withColumn("item_no", strip(F.try_element_at("record", F.col("_item")))).join(
        items.select("item_no", "avg_lb_per_case"), "item_no")
    num = lambda c: strip(F.try_element_at("record", c)).try_cast("double")
    out = keyed.select("source", "record", "avg_lb_per_case", F.explode("_pairs").alias("_p")).select(
        "source", F.col("_p.column").alias("column"), F.col("_p.qty_column").alias("qty_column"),
        num(F.col("_p.column")).alias("_v"), num(F.col("_p.qty_column")).alias("_q"), "avg_lb_per_case")
    return out.where("_v > 0 and _q > 0").select(
        "source", "column", "qty_column", (F.col("_v") / (F.col("_q") * F.col("avg_lb_per_case"))).alias("ratio"))


def header_variants(headers: DataFrame) -> DataFrame:
    """Runs of consecutive files (name order) with the same ordered header, with what each run added or removed.

    `headers` is one row per file (source, file_name, columns): its size is the number of files.
    """
    order = Window.partitionBy("source").orderBy("file_name")
    before = F.lag("columns").over(order)
    marked = headers.withColumn("_prev", before).withColumn(
        "_new", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("columns")), 1).otherwise(0))
    runs = marked.withColumn("variant", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("source", "variant").agg(
        F.min("file_name").alias("first_file"), F.max("file_name").alias("last_file"),
        F.count(F.lit(1)).alias("file_count"), F.min_by("columns", "file_name").alias("columns"),
        F.min_by("_prev", "file_name").alias("_prev"))
    previous = F.coalesce("_prev", "columns")
    return g.select("source", "variant", "columns", "first_file", "last_file", "file_count",
                    F.array_except("columns", previous).alias("added"),
                    F.array_except(previous, "columns").alias("removed"))


def findings(stats: DataFrame, shapes: DataFrame, variants: DataFrame, matches: DataFrame, units_: DataFrame
             ) -> DataFrame:
    """Plain-language observations a reviewer should act on, one row each (source, finding)."""
    f3 = lambda c: F.format_string("%.3f", c)
    change = F.array_join(F.filter(F.array(
        F.when(F.size("added") > 0, F.concat(F.lit("added "), F.array_join("added", ", "))),
        F.when(F.size("removed") > 0, F.concat(F.lit("removed "), F.array_join("removed", ", ")))),
        lambda x: x.isNotNull()), "; ")
    out = [variants.where("variant > 1").select("source", F.concat(
        F.lit("Header changes from "), F.col("first_file"), F.lit(": "), change,
        F.lit(". Possible schema drift — confirm before mapping.")).alias("finding"))]
    dates = stats.where("date_format is not null")
    out.append(dates.groupBy("source", "date_format").agg(F.array_sort(F.collect_set("column")).alias("c")).select(
        "source", F.concat(F.lit("Dates are "), F.col("date_format"), F.lit(" in "), F.array_join("c", ", "),
                           F.lit(".")).alias("finding")))
    out.append(dates.where("parsed_pct < 100").select("source", F.concat(
        F.col("column"), F.lit(": "), f3(100 - F.col("parsed_pct")),
        F.lit("% of non-blank values do not parse as "), F.col("date_format"), F.lit(".")).alias("finding")))
    out.append(units_.where("conflict").select("source", F.concat(
        F.col("column"), F.lit(": header says "), F.col("header_unit"), F.lit(" but magnitude says "),
        F.col("magnitude_unit"), F.lit(".")).alias("finding")))
    note = F.when(F.col("unit") == "kg",
                  F.lit(" Canonical weights are lb: convert and log the original value.")).otherwise(F.lit(""))
    out.append(units_.where("unit is not null").groupBy("source", "unit").agg(
        F.array_sort(F.collect_set("column")).alias("c")).select("source", F.concat(
            F.lit("Weights look like "), F.col("unit"), F.lit(" in "), F.array_join("c", ", "), F.lit("."), note)
            .alias("finding")))
    plain = lambda c: c.cast("string")
    out.append(stats.where("whitespace_pct > 0").select("source", F.concat(
        F.col("column"), F.lit(": "), plain(F.col("whitespace_pct")),
        F.lit("% of values carry leading/trailing whitespace.")).alias("finding")))
    out.append(stats.where("null_pct > 0").select("source", F.concat(
        F.col("column"), F.lit(": "), plain(F.col("null_pct")), F.lit("% blank.")).alias("finding")))
    out.append(stats.where("negative_count > 0").select("source", F.concat(
        F.col("column"), F.lit(": "), plain(F.col("negative_count")), F.lit(" negative values.")).alias("finding")))
    text = stats.where("dtype = 'string'").select("source", "column")
    s = shapes.join(text, ["source", "column"]).withColumn("_body", F.regexp_replace("shape", "·+$", ""))
    top = s.where("position = 1").select("source", "column", F.col("_body").alias("_top"))
    out.append(s.where("position > 1").join(top, ["source", "column"]).where(
        (F.col("_body") != F.col("_top")) & (F.col("share_pct") < RARE_SHAPE_PCT)).select("source", F.concat(
            F.col("column"), F.lit(": "), plain(F.col("share_pct")), F.lit("% of values have the rare shape `"),
            F.col("shape"), F.lit("` (e.g. '"), strip(F.col("example")), F.lit("').")).alias("finding")))
    out.append(matches.where("trimmed_pct < 100").select("source", F.concat(
        F.col("column"), F.lit(": "), f3(100 - F.col("trimmed_pct")), F.lit("% of values not in the "),
        F.col("master"), F.lit(" master.")).alias("finding")))
    known = matches.where("master = 'customers'").select("source").distinct()
    out.append(stats.select("source").distinct().join(known, "source", "left_anti").select("source", F.lit(
        "No column matches the customer master as-is — customer numbers are likely reformatted.").alias("finding")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
