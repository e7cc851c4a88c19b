"""Profiles of the raw extracts, the heuristic mapping, drift and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import drift, lineage, mapping
from tallyline.operators import profile as pf
from tallyline.plans.registry import cte, query
from tallyline.schema import COLUMNS, KIND
from tallyline.session import materialise
from tallyline.sources import driver_tables as dt

# ---- the profile as SQL --------------------------------------------------------------------------------------

_F = "trim(value) <> ''"
_NUM = r"case when regexp_full_match(trim(value), '-?\d+(\.\d+)?') then try_cast(trim(value) as double) end"
_INT = r"regexp_full_match(trim(value), '-?\d+(\.0+)?')"
_SL = r"regexp_full_match(trim(value), '\d{1,2}/\d{1,2}/\d{4}')"
_P = lambda a, b: f"case when {b} = 0 then 0 else round_even(100.0 * cast({a} as double) / {b}, 3) end"


def _stats_sql(by: str) -> str:
    return f"""select *, case when filled = 0 then 'empty' when date_format is not null then 'date' when i >= 0.98 *
      filled then 'integer' when dc >= 0.98 * filled then 'decimal' else 'string' end as dtype from (select *, case when
      filled = 0 then null when iso >= 0.98 * filled then 'iso' when sl >= 0.98 * filled then case when s2 > 12 and not
      s1 > 12 then 'us' when s1 > 12 and not s2 > 12 then 'dmy' else 'slash_ambiguous' end when i >= 0.98 * filled and
      ser >= 0.98 * filled then 'excel_serial' end as date_format from (select {by}, col, min(position) as position,
      count(*) as n, count(*) filter (where {_F}) as filled, count(distinct trim(value)) filter (where {_F}) as dv,
      count(*) filter (where {_F} and trim(value) <> value) as padded,
      count(*) filter (where regexp_full_match(trim(value), '\\d{{4}}-\\d{{2}}-\\d{{2}}')) as iso,
      count(*) filter (where {_SL}) as sl,
      max(case when {_SL} then cast(split_part(trim(value), '/', 1) as integer) else 0 end) as s1,
      max(case when {_SL} then cast(split_part(trim(value), '/', 2) as integer) else 0 end) as s2,
      count(*) filter (where {_INT}) as i, count(*) filter (where {_INT} and {_NUM} between 36526 and 55153) as ser,
      count(*) filter (where {_NUM} is not null) as dc, count(*) filter (where {_NUM} < 0) as neg,
      min({_NUM}) as mn, max({_NUM}) as mx,
      count(*) filter (where try_strptime(trim(value), '%Y-%m-%d') is not null) as ok_iso,
      count(*) filter (where try_strptime(trim(value), '%m/%d/%Y') is not null) as ok_us,
      count(*) filter (where try_strptime(trim(value), '%d/%m/%Y') is not null) as ok_dmy
      from cells group by {by}, col) a) b"""


cte("st", ["cells"], _stats_sql("source"))
cte("stb", ["cells"], _stats_sql("source, batch_id"))
_SHAPE = ("concat(regexp_replace(regexp_replace(rtrim(value), '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g'), "
          "repeat('·', length(value) - length(rtrim(value))))")


def _shapes_sql(by: str) -> str:
    return f"""select *, row_number() over (partition by {by}, col order by n desc, shape) as position, sum(n) over
      (partition by {by}, col) as total from (select {by}, col, {_SHAPE} as shape, count(*) as n, min_by(value,
      concat(batch_id, '~', source_row)) as example from cells where {_F} group by all) s"""


cte("sh", ["cells"], _shapes_sql("source"))
cte("shb", ["cells"], _shapes_sql("source, batch_id"))
cte("mm", ["cells", "custs", "its", "plts"], f"""select * from (select *, row_number() over (partition by source, col
    order by trimmed_pct desc, master) as r from (select c.source, c.col, k.master, {_P("count(*) filter (where value = "
    "k.key)", "t.total")} as exact_pct, {_P("count(*)", "t.total")} as trimmed_pct from cells c join (select 'customers'
    as master, customer_no as key from custs union all select 'items', item_no from its union all select 'plants', plant
    from plts) k on trim(c.value) = k.key join (select source, col, count(*) as total from cells where {_F} group by
    1, 2) t on t.source = c.source and t.col = c.col where {_F} group by c.source, c.col, k.master, t.total) x where
    trimmed_pct >= 88.2) y where r = 1""")


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """The value table every profile statistic reads; stored, because a profile reads it several times."""
    return dt.stored(spark, d, "source_values", lambda: pf.value_counts(pf.cells(dt.bronze(spark, d)), ["source"]))


def batch_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells by extract, as they are: what fingerprints ask of them folds in the task that reads them."""
    return pf.weighted_cells(pf.cells(dt.bronze(spark, d)))


def batch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Types, formats and blanks per extract; nobody asks for distinct values by extract."""
    return dt.stored(spark, d, "batch_stats", lambda: pf.column_stats(batch_cells(spark, d), ["source", "batch_id"], False))


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row per source column; stored, as findings, units, keys and the mapping all start from it."""
    return dt.stored(spark, d, "source_stats", lambda: pf.column_stats(pf.weighted_cells(pf.cells(dt.bronze(spark, d))), ["source"]))


def source_matches(spark: SparkSession, d: str) -> DataFrame:
    return dt.stored(spark, d, "source_matches", lambda: pf.master_match(source_counts(spark, d), master_keys(spark, d)))


def source_units(spark: SparkSession, d: str) -> DataFrame:
    return dt.stored(spark, d, "source_units", lambda: pf.units(source_stats(spark, d), pf.unit_ratios(pf.ratio_pairs(
        dt.bronze(spark, d), source_stats(spark, d), source_matches(spark, d), dt.items(spark, d)), lambda df: materialise(
            df, "ratios"))))


def master_keys(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda df, m, c: df.select(F.lit(m).alias("master"), F.col(c).alias("key"))
    return pick(dt.customers(spark, d), "customers", "customer_no").unionByName(
        pick(dt.items(spark, d), "items", "item_no")).unionByName(pick(dt.plants(spark, d), "plants", "plant"))


_STATS_OUT = f"""source, col as column_name, cast(n as bigint) as rows, cast(filled as bigint) as filled, dtype,
    date_format, case date_format when 'iso' then {_P('ok_iso', 'filled')} when 'dmy' then {_P('ok_dmy', 'filled')} when
    'excel_serial' then {_P('ser', 'filled')} when 'us' then {_P('ok_us', 'filled')} when 'slash_ambiguous' then
    {_P('ok_us', 'filled')} end as parsed_pct, {_P('n - filled', 'n')} as null_pct, {_P('dv', 'filled')} as distinct_pct,
    {_P('padded', 'filled')} as whitespace_pct, cast(case when dtype in ('integer', 'decimal') then neg end as bigint) as
    negative_count, case dtype when 'integer' then cast(cast(mn as bigint) as varchar) when 'decimal' then cast(mn as
    varchar) end as min_value, case dtype when 'integer' then cast(cast(mx as bigint) as varchar) when 'decimal' then
    cast(mx as varchar) end as max_value"""


@query("a17_column_profile", ["st"], f"select {_STATS_OUT} from st")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return source_stats(spark, d).withColumnRenamed("column", "column_name")


@query("a18_type_and_date_vote", ["stb"], "select source, batch_id, col as column_name, dtype, date_format from stb")
def type_vote(spark: SparkSession, d: str) -> DataFrame:
    return batch_stats(spark, d).select(
        "source", "batch_id", F.col("column").alias("column_name"), "dtype", "date_format")


@query("a19_top_shapes", ["sh"], f"""select source, col as column_name, cast(position as integer) as position, shape,
    {_P('n', 'total')} as share_pct, example from sh where position <= 3""")
def top_shapes(spark: SparkSession, d: str) -> DataFrame:
    return pf.top_shapes(source_counts(spark, d), ["source"], cells_=pf.cells(dt.bronze(spark, d))).withColumnRenamed(
        "column", "column_name")


@query("a20_master_match", ["mm"], "select source, col as column_name, master, exact_pct, trimmed_pct from mm")
def master_match(spark: SparkSession, d: str) -> DataFrame:
    return source_matches(spark, d).withColumnRenamed("column", "column_name")


cte("un", ["cells", "st", "mm", "its"], """with med as (select v.source, v.col, q.col as qty, median(v.x / (q.x *
    i.lb)) as m, count(*) as n from (select c.source, c.col, source_row, try_cast(trim(value) as double) as x from cells
    c join st on st.source = c.source and st.col = c.col where st.dtype = 'decimal') v
    join (select c.source, c.col, source_row, try_cast(trim(value) as double) as x from cells c join st on
      st.source = c.source and st.col = c.col where st.dtype = 'integer' and not exists (select 1 from mm where
      mm.source = c.source and mm.col = c.col)) q on q.source = v.source and q.source_row = v.source_row
    join (select c.source, source_row, avg_lb_per_case as lb from cells c join mm on mm.source = c.source and mm.col =
      c.col and mm.master = 'items' join its on its.item_no = trim(c.value)) i on i.source = v.source and i.source_row =
      v.source_row where v.x > 0 and q.x > 0 group by 1, 2, 3)
    select source, col, qty, round_even(m, 4) as ratio from (select *, row_number() over (partition by source, col order
    by least(abs(ln(m)), abs(ln(m * cast(2.2046226218 as double)))), qty) as r from med where n >= 30) z where r = 1""")


@query("a21_unit_inference", ["st", "un"], """select *, case when not conflict then coalesce(header_unit,
    magnitude_unit) end as unit from (select *, coalesce(header_unit <> magnitude_unit, false) as conflict from (select
    st.source, st.col as column_name, ratio, case when st.col like '%KG%' then 'kg' end as header_unit, case when
    abs(ln(ratio)) <= 0.15 then 'lb' when abs(ln(ratio * 2.2046226218)) <= 0.15 then 'kg' end as magnitude_unit from st
    left join un on un.source = st.source and un.col = st.col where st.dtype = 'decimal') a where header_unit is not
    null or magnitude_unit is not null) b""")
def unit_inference(spark: SparkSession, d: str) -> DataFrame:
    return source_units(spark, d).select(
        "source", F.col("column").alias("column_name"), "ratio", "header_unit", "magnitude_unit", "conflict", "unit")


def positions(spark: SparkSession) -> DataFrame:
    rows = {}
    for source, _, _, header in dt.HEADERS:
        for name in header:
            rows.setdefault((source, name), len(rows))
    return spark.createDataFrame([(s, c, p) for (s, c), p in rows.items()], "source string, column string, position int")


@query("a22_candidate_key", ["cells", "st"], f"""with el as (select c.*, st.position as pos from (select source,
    source_row, col, trim(value) as v from cells) c join st on st.source = c.source and st.col = c.col where st.dtype in
    ('string', 'integer') and {_P('n - filled', 'n')} < 1),
    rows_of as (select source, count(*) as n from raw group by 1),
    sets as (select source, a, b, k1, k2, n - count(*) as dups, n from (select distinct x.source, x.col as a, null as b,
      x.pos as k1, -1 as k2, x.v as v1, null as v2, n from el x join rows_of using (source)
      union all select distinct x.source, x.col, y.col, x.pos, y.pos, x.v, y.v, n from el x join el y on x.source =
      y.source and x.source_row = y.source_row and x.pos < y.pos join rows_of r on r.source = x.source) u
      group by source, a, b, k1, k2, n)
    select source, case when b is null then a else concat(a, ',', b) end as key_columns, cast(dups as bigint) as
    duplicate_rows, {_P('dups', 'n')} as duplicate_pct from (select *, row_number() over (partition by source order by
    dups, k2 >= 0, k1, k2) as r from sets where {_P('dups', 'n')} <= 2) z where r = 1""")
def candidate_key(spark: SparkSession, d: str) -> DataFrame:
    return pf.candidate_key(dt.bronze(spark, d), source_stats(spark, d), positions(spark), source_counts(spark, d))


@query("a23_exact_duplicate_rows", ["raw"], f"""select source, cast(sum(n - 1) as bigint) as exact_duplicate_rows from
    (select source, count(*) as n from raw group by source, {', '.join(f'r_{c}' for c in COLUMNS)},
    case when source = 'plt02' and r_customer_no <> '' then order_year >= '1998' end) g group by 1""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return pf.exact_duplicates(dt.bronze(spark, d))


_HEADER_CASE = "case " + " ".join(
    f"when source = '{s}' and order_year >= '{lo}' and order_year < '{hi}' then '{','.join(h)}'"
    for s, lo, hi, h in dt.HEADERS) + " end"
cte("hdr", ["bts"], f"select batch_id, source, file_name, {_HEADER_CASE} as header from bts")


def file_headers(spark: SparkSession, d: str) -> DataFrame:
    return pf.headers_of(dt.bronze(spark, d)).withColumn("file_name", F.concat(
        "source", F.lit("_orderlines_"), F.split("batch_id", ":")[1], F.lit("-01.csv")))


@query("w05_header_variants", ["hdr"], """with m as (select *, lag(header) over (partition by source order by
    file_name) as prev from hdr), r as (select *, sum(case when prev is null or prev <> header then 1 else 0 end) over
    (partition by source order by file_name) as variant from m), g as (select source, variant, min(file_name) as
    first_file, max(file_name) as last_file, count(*) as file_count, min_by(header, file_name) as h, min_by(coalesce(prev,
    header), file_name) as p from r group by 1, 2) select source, cast(variant as bigint) as variant, first_file,
    last_file, cast(file_count as bigint) as file_count, array_to_string(list_filter(string_split(h, ','), lambda x: not
    list_contains(string_split(p, ','), x)), ',') as added, array_to_string(list_filter(string_split(p, ','), lambda x:
    not list_contains(string_split(h, ','), x)), ',') as removed from g""")
def header_variants(spark: SparkSession, d: str) -> DataFrame:
    return pf.header_variants(file_headers(spark, d)).select(
        "source", "variant", "first_file", "last_file", "file_count", F.array_join("added", ",").alias("added"),
        F.array_join("removed", ",").alias("removed"))


@query("e13_findings")
def findings(spark: SparkSession, d: str) -> DataFrame:
    shapes = materialise(pf.top_shapes(source_counts(spark, d), ["source"], cells_=pf.cells(dt.bronze(spark, d))), "shapes")
    return pf.findings(source_stats(spark, d), shapes, pf.header_variants(file_headers(spark, d)), source_matches(spark, d),
                       source_units(spark, d))


@query("u01_union_of_headers", ["cells"], """select source, col as column_name, cast(count(*) as bigint) as present,
    cast(count(*) filter (where value = '') as bigint) as blank from cells group by 1, 2""")
def union_of_headers(spark: SparkSession, d: str) -> DataFrame:
    """Files with differing headers side by side: an absent column is NULL, a blank stays ''."""
    bronze, wide = dt.bronze(spark, d), None
    for source, lo, hi, header in dt.HEADERS:
        part = bronze.where((F.col("source") == source) & (F.col("order_year") >= lo) & (F.col("order_year") < hi)) \
            .select("source", *[F.element_at("record", h).alias(h) for h in header])
        wide = part if wide is None else wide.unionByName(part, allowMissingColumns=True)
    names = [c for c in wide.columns if c != "source"]
    one = wide.groupBy("source").agg(*[x for c in names for x in (
        F.count(F.col(f"`{c}`")).alias(f"p_{c}"), F.count_if(F.col(f"`{c}`") == "").alias(f"b_{c}"))])
    return one.select("source", F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(f"`p_{c}`").alias("present"), F.col(f"`b_{c}`").alias("blank"))
        for c in names])).alias("_c")).select("source", "_c.*").where("present > 0")


# ---- mapping -------------------------------------------------------------------------------------------------

def mapping_profile(spark: SparkSession, d: str) -> DataFrame:
    """One row per source column; a profile is made once per set of extracts and kept."""
    return dt.stored(spark, d, "profile", lambda: _mapping_profile(spark, d))


def _mapping_profile(spark: SparkSession, d: str) -> DataFrame:
    stats, matches = source_stats(spark, d), source_matches(spark, d)
    units = source_units(spark, d).select("source", "column", "unit", F.lit(True).alias("_unit"))
    top = pf.top_shapes(source_counts(spark, d), ["source"], 1).select("source", "column", F.regexp_replace(
        "shape", "·+$", "").alias("top_shape"))
    on = ["source", "column"]
    return (stats.join(matches.drop("exact_pct"), on, "left").join(units, on, "left").join(top, on, "left")
            .withColumn("has_unit", F.coalesce("_unit", F.lit(False))).drop("_unit"))


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """Distinct headers with their columns, one row per column."""
    variants = pf.header_variants(file_headers(spark, d))
    return variants.select("source", mapping.header_hash(F.col("columns")).alias("header_hash"), F.posexplode(
        "columns").alias("position", "source_col")).distinct()


@query("m01_name_concepts")
def name_concepts(spark: SparkSession, d: str) -> DataFrame:
    names = header_rows(spark, d).select("source_col").distinct()
    return names.select("source_col", F.array_join(mapping.concepts("source_col"), ",").alias("concepts"))


@query("m02_name_scores")
def name_scores(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.schema import canonical_fields

    names = header_rows(spark, d).select("source_col").distinct().select(
        "source_col", mapping.concepts("source_col").alias("found"))
    return names.crossJoin(F.broadcast(canonical_fields(spark))).select(  # fifteen fixed rows
        "source_col", "canonical_col", F.round(mapping.name_score(F.col("found"), F.col("concepts")), 6).alias("score"))


_KINDS = ", ".join(f"('{c}', '{k}')" for c, k in KIND.items())
_NUMBER, _DISTINCT = "dtype in ('decimal', 'integer')", _P("dv", "filled")


@query("m03_evidence_scores", ["st", "mm", "un"], f"""select source, column_name, canonical_col, cast(case kind
    when 'date' then case when dtype = 'date' then 1 else 0 end
    when 'weight' then case when not {_NUMBER} then 0 when unit then 1 else 0.3 end
    when 'qty' then case when not {_NUMBER} or unit then 0 when dtype = 'integer' then 1 else 0.6 end
    when 'line' then case when dtype = 'integer' and mx < 1000 and master is null then 1 else 0 end
    when 'order_id' then case when master is not null or dtype not in ('string', 'integer') then 0 when dp >= 5 then 1
      else 0.2 end
    when 'customer' then case when master = 'customers' then 1 when master is not null or dtype not in ('string',
      'integer') or dp >= 5 then 0 else 0.7 end
    when 'item' then case when master = 'items' then 1 when master is null and dtype = 'string' and dp < 5 then 0.4
      else 0 end
    when 'plant' then case when master = 'plants' then 1 when master is null and dtype = 'string' and dp < 0.1 then 0.3
      else 0 end
    when 'uom' then case when master is null and dtype = 'string' and dp < 1 then 1 else 0 end
    when 'lot' then case when master is null and dtype = 'string' and dp >= 50 then 1 else 0 end end as double) as
    evidence from (select st.source, st.col as column_name, dtype, mx, mm.master, {_DISTINCT} as dp, st.dtype =
    'decimal' and (st.col like '%KG%' or abs(ln(ratio)) <= 0.15 or abs(ln(ratio * 2.2046226218)) <= 0.15) is true as
    unit from st left join mm on mm.source = st.source and mm.col = st.col left join un on un.source = st.source and
    un.col = st.col) p cross join (values {_KINDS}) f(canonical_col, kind)""")
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.schema import canonical_fields

    return mapping_profile(spark, d).crossJoin(F.broadcast(canonical_fields(spark))).select(  # fifteen fixed rows
        "source", F.col("column").alias("column_name"), "canonical_col",
        mapping.evidence_score(F.col("kind")).alias("evidence"))


def proposals(spark: SparkSession, d: str) -> DataFrame:
    return mapping.propose(mapping_profile(spark, d), header_rows(spark, d))


@query("m04_propose_mapping")
def propose(spark: SparkSession, d: str) -> DataFrame:
    return proposals(spark, d).withColumn("transforms", F.array_join("transforms", ","))


@query("t02_one_to_one_assignment")
def assignment(spark: SparkSession, d: str) -> DataFrame:
    pairs = mapping.score_pairs(mapping_profile(spark, d), header_rows(spark, d))
    return mapping.assign(pairs).select("source", "header_hash", "source_col", "canonical_col",
                                        F.round("score", 6).alias("score"))


# A mapping per extract, some of them broken on purpose: a column listed twice, one missing, a bad parser.
_MAP_ROWS = [(f"{s}:{i}", i, h, c, {"date": dt.TRANSFORMS_BY_SOURCE[s]["date"]}.get(KIND[c], ""))
             for s, lo, hi, header in dt.HEADERS if lo == "0000" for i, (h, c) in enumerate(zip(header, COLUMNS))]


def proposed_per_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every extract's columns with the field a careless mapper gives them."""
    config = spark.createDataFrame([(k.split(":")[0], h, c, t) for k, _, h, c, t in _MAP_ROWS],
                                   "source string, source_col string, canonical_col string, t string")
    broken = F.col("batch_id").endswith("1996")
    return pf.headers_of(dt.bronze(spark, d)).select("source", "batch_id", F.explode("columns").alias("source_col")) \
        .join(config, ["source", "source_col"]).select(
        F.col("batch_id").alias("mapping_id"), "source_col",
        F.when(broken & (F.col("canonical_col") == "uom"), "lot_no").otherwise(F.col("canonical_col"))
        .alias("canonical_col"),
        F.when(broken & (F.col("canonical_col") == "plant"), F.array(F.lit("kg_to_lb"))).when(
            F.col("t") == "", F.array().cast("array<string>")).otherwise(F.array("t")).alias("transforms"))


_CFG = ", ".join(f"('{k.split(':')[0]}', '{h}', '{c}', '{t}')" for k, _, h, c, t in _MAP_ROWS)
cte("pm", ["cells"], f"""select c.batch_id as mapping_id, c.col as source_col, case when c.batch_id like '%1996' and
    m.canonical = 'uom' then 'lot_no' else m.canonical end as canonical_col, case when c.batch_id like '%1996' and
    m.canonical = 'plant' then 'kg_to_lb' else m.t end as t from (select distinct source, batch_id, col from cells) c
    join (values {_CFG}) m(source, col, canonical, t) on m.source = c.source and m.col = c.col""")


@query("m05_contract_violations", ["pm", "cells"], """
    select mapping_id, 'kg_to_lb only applies to weights' as problem, source_col as subject from pm where t = 'kg_to_lb'
      and canonical_col not in ('ordered_weight_lb', 'invoiced_weight_lb')
    union all select batch_id, 'header column missing', col from (select distinct batch_id, col from cells) c where not
      exists (select 1 from pm where pm.mapping_id = c.batch_id and pm.source_col = c.col)
    union all select mapping_id, 'canonical column mapped more than once', canonical_col from pm group by 1, 3
      having count(*) > 1""")
def contract(spark: SparkSession, d: str) -> DataFrame:
    headers = pf.headers_of(dt.bronze(spark, d)).select(F.col("batch_id").alias("mapping_id"),
                                                        F.explode("columns").alias("source_col"))
    return mapping.contract_violations(proposed_per_batch(spark, d), headers)


@query("u06_unmapped_required", ["pm"], """select mapping_id, array_to_string(list_sort(list_filter(['order_no',
    'line_no', 'customer_no', 'item_no', 'plant', 'order_date', 'requested_date', 'confirmed_delivery_date',
    'issue_date', 'ordered_qty'], lambda r: not list_contains(have, r))), ',') as missing from (select mapping_id,
    list(canonical_col) as have from pm group by 1) g""")
def unmapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.unmapped_required(proposed_per_batch(spark, d)).withColumn("missing", F.array_join("missing", ","))


# Decisions on one mapping version per extract: confirmed in file order, every fifth rejected first.
_VERSIONS = """(select batch_id, source, order_year, header_hash, row_number() over (partition by source order by
    order_year) as version from bts)"""
_MISSING_N = "case when order_year = '1997' then 1 else 0 end"


def versions_from_batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = dt.batches(spark, d).select(
        F.col("batch_id").alias("mapping_version_id"), "source", "header_hash", F.lit("proposed").alias("status"),
        F.col("order_year").cast("bigint").alias("decision_id"),
        F.when(F.col("order_year") == "1997", 1).otherwise(0).alias("unmapped_required"))
    decisions = v.select("mapping_version_id", "decision_id", F.when(
        F.col("decision_id") % 5 == 0, "reject").otherwise("confirm").alias("action"))
    return v.drop("decision_id"), decisions


@query("m06_mapping_lifecycle", ["bts"], f"""select batch_id as mapping_version_id, source, case when s = 'confirmed' and
    y < max(case when s = 'confirmed' then y end) over (partition by source, header_hash) then 'superseded' else s end as
    status from (select *, cast(order_year as integer) as y, case when cast(order_year as integer) % 5 = 0 then
    'rejected' when {_MISSING_N} > 0 then 'proposed' else 'confirmed' end as s from bts) x""")
def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    versions, decisions = versions_from_batches(spark, d)
    return mapping.lifecycle(versions, decisions).select("mapping_version_id", "source", "status")


@query("m07_header_hash", ["hdr"], """select batch_id, source, sha256(concat('["', replace(header, ',', '","'), '"]')) as
    header_hash from hdr""")
def header_hashes(spark: SparkSession, d: str) -> DataFrame:
    return pf.headers_of(dt.bronze(spark, d)).select("batch_id", "source", mapping.header_hash(
        F.col("columns")).alias("header_hash"))


@query("w09_version_numbers", ["bts"], """select source, batch_id, cast(coalesce(top, 0) + row_number() over (partition by
    b.source order by order_year) as integer) as version from bts b left join (values ('plt01', 6), ('plt02', 4),
    ('plt03', 7)) t(source, top) using (source) where not (b.source = 'plt01' and order_year = '1999')""")
def version_numbers(spark: SparkSession, d: str) -> DataFrame:
    existing = dt.mapping_versions(spark, d).select("source", "version", "status", "header_hash", "proposed_by").distinct()
    live_key = F.when((F.col("source") == "plt01") & (F.col("version") == 2), "plt01:1999").otherwise("older")
    new = dt.batches(spark, d).select("source", "header_hash", F.lit("human").alias("proposed_by"),
                                      F.col("batch_id").alias("mapping_key"), F.col("order_year").alias("proposal_order"),
                                      "batch_id")
    return mapping.number_versions(existing.withColumn("mapping_key", live_key), new).select("source", "batch_id",
                                                                                           "version")


# ---- bronze to silver ----------------------------------------------------------------------------------------

@query("f01_bronze_to_silver", ["ol", "raw"], """select ol.batch_id, ol.source_row, ol.order_no, ol.line_no, ol.customer_no,
    ol.item_no, ol.plant, cast(ol.order_date as varchar) as order_date, cast(ol.requested_date as varchar) as
    requested_date, cast(ol.confirmed_delivery_date as varchar) as confirmed_delivery_date, cast(ol.issue_date as varchar)
    as issue_date, ol.ordered_qty, ol.invoiced_qty, round(try_cast(r_ordered_weight_lb as double) * case when ol.source =
    'plt02' then cast(2.2046226218 as double) else 1 end, 6) as ordered_weight_lb, ol.uom, ol.lot_no, coalesce(case when
    bad_issue is not null then concat('issue_date=', bad_issue) end, '') as parse_errors
    from ol join raw using (batch_id, source_row)""")
def bronze_to_silver(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators.ingest import build_silver

    out = build_silver(dt.bronze(spark, d), dt.mapping_versions(spark, d))
    errors = F.array_join(F.transform(F.map_entries("parse_errors"), lambda e: F.concat_ws("=", e["key"], e["value"])),
                          ";")
    return out.select("batch_id", "source_row", "order_no", "line_no", "customer_no", "item_no", "plant",
                      *[F.col(c).cast("string").alias(c) for c in ("order_date", "requested_date",
                                                                   "confirmed_delivery_date", "issue_date")],
                      "ordered_qty", "invoiced_qty", F.round("ordered_weight_lb", 6).alias("ordered_weight_lb"), "uom",
                      "lot_no", errors.alias("parse_errors"))


@query("f02_mapping_gate", ["bts"], """select batch_id, case when header_hash in ('plt01-b', 'plt03-a') then 'mapped' else
    'blocked' end as status, case when header_hash not in ('plt01-b', 'plt03-a') then concat(
    'no confirmed mapping for header ', header_hash, '; propose and confirm one, then run again') end as error from bts""")
def mapping_gate(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators.ingest import gate

    known = dt.mapping_versions(spark, d).where("header_hash in ('plt01-b', 'plt03-a')")
    return gate(dt.batches(spark, d), known).select("batch_id", "status", "error")


@query("f03_resume_blocked", ["bts"], """select batch_id, source from bts where header_hash not in ('plt01-b', 'plt03-a')
    and header_hash <> 'plt02-b'""")
def resume_blocked(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators.ingest import gate, resumable

    versions = dt.mapping_versions(spark, d)
    before = gate(dt.batches(spark, d), versions.where("header_hash in ('plt01-b', 'plt03-a')"))
    return resumable(before, versions.where("header_hash <> 'plt02-b'")).select("batch_id", "source")


@query("j10_confirmed_mapping", ["bts"], """select batch_id, case header_hash when 'plt01-a' then 1 when 'plt01-b' then 2
    when 'plt02-a' then 3 when 'plt02-b' then 4 else 5 end as mapping_version_id, cast(case header_hash when 'plt01-a'
    then 14 else 15 end as bigint) as mapped_columns from bts""")
def confirmed_mapping(spark: SparkSession, d: str) -> DataFrame:
    from tallyline.operators.ingest import confirmed_columns

    return dt.batches(spark, d).join(confirmed_columns(dt.mapping_versions(spark, d)), ["source", "header_hash"]).select(
        "batch_id", "mapping_version_id", F.size("columns").cast("bigint").alias("mapped_columns"))


# ---- drift ---------------------------------------------------------------------------------------------------

_NB = lambda p: f"case when {p} <= 5 then 'sparse' when {p} <= 50 then 'partial' else 'mostly' end"
cte("fp", ["stb", "shb"], f"""select a.source, a.batch_id, a.col, dtype, {_NB(_P('a.n - filled', 'a.n'))} as nb, case when
    date_format is not null then concat('date:', date_format) when dtype = 'string' and {_P('s.n', 's.total')} >= 90 then
    concat('shape:', rtrim(s.shape, '·')) else dtype end as pattern from stb a left join shb s on s.source = a.source and
    s.batch_id = a.batch_id and s.col = a.col and s.position = 1""")
cte("fpd", ["fp"], """select source, batch_id, sha256(string_agg(concat_ws('|', col, dtype, nb, pattern), ';' order by
    col)) as digest from fp group by 1, 2""")
cte("chain", ["fpd"], """select *, lag(digest) over w as prev, lag(batch_id) over w as prev_batch from fpd window w as
    (partition by source order by batch_id)""")
cte("al", ["chain"], """select * from (select *, row_number() over (partition by source, digest order by batch_id) as r
    from chain where prev <> digest) x where r = 1""")
cte("df", ["fp", "chain"], """select c.source, c.batch_id, coalesce(o.col, n.col) as col, case when n.col is null then
    'removed' when o.col is null then 'added' else 'changed' end as change, o.sig as before, n.sig as after from
    (select * from chain where prev is not null) c cross join lateral (select distinct col from fp where batch_id in
    (c.batch_id, c.prev_batch)) k left join (select *, concat_ws('/', dtype, nb, pattern) as sig from fp) o on o.batch_id
    = c.prev_batch and o.col = k.col left join (select *, concat_ws('/', dtype, nb, pattern) as sig from fp) n on
    n.batch_id = c.batch_id and n.col = k.col where o.sig is distinct from n.sig""")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """One row per extract; stored, because whatever compares extracts reads them several times."""
    return dt.stored(spark, d, "fingerprints", lambda: drift.fingerprints(batch_stats(spark, d), pf.top_shapes(
        batch_cells(spark, d), ["source", "batch_id"], 1)))


def chain(spark: SparkSession, d: str) -> DataFrame:
    return drift.history(fingerprints(spark, d).withColumn("arrival", F.col("batch_id")))


@query("d01_fingerprints", ["fp", "fpd"], """select source, batch_id, digest, cast((select count(*) from fp where
    fp.batch_id = fpd.batch_id) as integer) as columns from fpd""")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(spark, d).select("source", "batch_id", "digest", F.size("columns").alias("columns"))


@query("w06_previous_fingerprint", ["chain"], "select source, batch_id, digest, prev as previous_digest from chain")
def previous(spark: SparkSession, d: str) -> DataFrame:
    return chain(spark, d).select("source", "batch_id", "digest", "previous_digest")


@query("w07_alert_once", ["al"], "select source, batch_id, digest from al")
def alert_once(spark: SparkSession, d: str) -> DataFrame:
    return drift.alerts(chain(spark, d)).select("source", "batch_id", "digest")


@query("u02_column_diff", ["df"], "select source, batch_id, col as column_name, change, before, after from df")
def column_diff(spark: SparkSession, d: str) -> DataFrame:
    return drift.diff(chain(spark, d)).withColumnRenamed("column", "column_name")


_RENAMES = """(select o.source, o.batch_id, o.sig as signature, o.col as from_column, n.col as to_column from (select *,
    before as sig, row_number() over (partition by batch_id, before order by col) as k from df where change = 'removed')
    o join (select *, after as sig, row_number() over (partition by batch_id, after order by col) as k from df where
    change = 'added') n on n.batch_id = o.batch_id and n.sig = o.sig and n.k = o.k)"""


@query("t03_rename_pairs", ["df"], f"select * from {_RENAMES} r")
def rename_pairs(spark: SparkSession, d: str) -> DataFrame:
    return drift.renames(drift.diff(chain(spark, d)))


@query("d02_diff_and_renames", ["df"], f"""select batch_id, cast(count(*) filter (where change = 'removed') as bigint) as
    removed, cast(count(*) filter (where change = 'added') as bigint) as added, cast(count(*) filter (where change =
    'changed') as bigint) as changed, cast(coalesce(max(n), 0) as bigint) as renamed from df left join (select batch_id,
    count(*) as n from {_RENAMES} r group by 1) q using (batch_id) group by 1""")
def diff_and_renames(spark: SparkSession, d: str) -> DataFrame:
    changes = drift.diff(chain(spark, d))
    renamed = drift.renames(changes).groupBy("batch_id").agg(F.count(F.lit(1)).alias("renamed"))
    counts = changes.groupBy("batch_id").agg(*[F.count_if(F.col("change") == c).alias(c)
                                               for c in ("removed", "added", "changed")])
    return counts.join(renamed, "batch_id", "left").withColumn(
        "renamed", F.coalesce("renamed", F.lit(0).cast("bigint")))


@query("d03_drift_check", ["chain", "al"], """select c.batch_id, c.digest is distinct from c.prev and c.prev is not null
    as shape_changed, a.batch_id as alerted_by from chain c left join al a on a.source = c.source and a.digest = c.digest""")
def drift_check(spark: SparkSession, d: str) -> DataFrame:
    c = chain(spark, d)
    raised = drift.alerts(c).select("source", "digest", F.col("batch_id").alias("alerted_by"))
    return c.join(raised, ["source", "digest"], "left").select(
        "batch_id", F.coalesce(F.col("digest") != F.col("previous_digest"), F.lit(False)).alias("shape_changed"),
        "alerted_by")


@query("d04_alert_messages")
def alert_messages(spark: SparkSession, d: str) -> DataFrame:
    c = chain(spark, d)
    changes = drift.diff(c)
    versions = dt.mapping_versions(spark, d)
    impacts = lineage.impact(lineage.record(None, versions), versions)
    guesses = proposals(spark, d).where("canonical_col is not null").select("source", F.col("source_col").alias("column"),
                                                                          "canonical_col").distinct()
    proposed = changes.where("change = 'added'").select("source", "batch_id", "column").join(guesses, ["source", "column"])
    out = drift.messages(drift.alerts(c), changes, drift.renames(changes), impacts, proposed)
    return out.withColumn("affected_canonical", F.array_join("affected_canonical", ","))


@query("d05_alert_resolution", ["bts"], """select cast(substr(batch_id, 7) as integer) as alert_id, source, case when
    header_hash <> 'plt02-b' and source <> 'plt03' then 'resolved' else 'open' end as status, case when header_hash <>
    'plt02-b' and source <> 'plt03' then 'owner' end as resolved_by, case when header_hash = 'plt02-b' then
    'confirm a mapping for the new header before resolving this alert' end as refused, header_hash <> 'plt02-b' as
    mapping_confirmed from bts""")
def alert_resolution(spark: SparkSession, d: str) -> DataFrame:
    alerts = dt.batches(spark, d).select(
        F.concat_ws(":", "source", "order_year").alias("alert_id"), "source", "header_hash", F.lit("open").alias("status"))
    asked = alerts.where("source <> 'plt03'").select("alert_id", F.lit("owner").alias("actor"))
    confirmed = dt.mapping_versions(spark, d).where("status = 'confirmed' and header_hash <> 'plt02-b'")
    return drift.resolve(alerts, asked, confirmed).select(
        F.split("alert_id", ":")[1].cast("int").alias("alert_id"), "source", "status", "resolved_by", "refused",
        "mapping_confirmed")


@query("d06_fingerprint_backfill", ["fpd"], "select source, batch_id, digest from fpd where source <> 'plt03'")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints for extracts that have none yet, rebuilt from bronze."""
    prints = fingerprints(spark, d)
    recorded = dt.batches(spark, d).where("source = 'plt03'").select("batch_id")
    return prints.join(recorded, "batch_id", "left_anti").select("source", "batch_id", "digest")


# ---- lineage -------------------------------------------------------------------------------------------------
# Weighted by the rows each source column carried, so that the answer comes from the extracts, not from configuration.

_LIN = ", ".join(f"('{s}', '{h}', '{c}')" for s, h, c in sorted({(s, h, c) for s, _, _, header in dt.HEADERS
                                                             for h, c in zip(header, COLUMNS)}))
_OTIF = {"order_no", "line_no", "plant", "customer_no", "item_no", "issue_date", "confirmed_delivery_date",
         "requested_date", "ordered_qty", "invoiced_qty", "ordered_weight_lb", "invoiced_weight_lb"}


def _views_sql() -> str:
    dims = ["order_no", "line_no", "issue_date", "plant", "customer_no", "item_no"]
    qty, weight = ["invoiced_qty", "ordered_qty"], ["invoiced_weight_lb", "ordered_weight_lb"]
    reads = {"otif_v3_lines": [*dims, "confirmed_delivery_date", *qty, *weight],
             "otif_v2_lines": [*dims, "confirmed_delivery_date", *qty],
             "otif_date_basis_v1_lines": [*dims, "requested_date", *qty, *weight],
             "otif_case_tolerance_v1_lines": [*dims, "confirmed_delivery_date", *qty],
             "fill_rate_v1_lines": [*dims, *qty, *weight]}
    on = {"ops_otif_monthly_plant": "otif_v3_lines", "sales_otif_daily_customer": "otif_v3_lines",
          "legacy_otif_monthly_plant": "otif_v2_lines", "ops_fill_rate_monthly_plant": "fill_rate_v1_lines",
          "sales_fill_rate_daily_customer": "fill_rate_v1_lines"}
    rows = [(c, f"gold.{v}") for v, cs in reads.items() for c in cs]
    rows += [(c, f"gold.consumer_{k}") for k, v in on.items() for c in reads[v]]
    return ", ".join(f"('{c}', '{v}')" for c, v in rows)


cte("lin", [], f"select * from (values {_LIN}) t(source, col, canonical)")
cte("vw", [], f"select * from (values {_views_sql()}) t(canonical, view_name)")


@query("l01_lineage_rows", ["cells", "lin"], """select c.source, c.col as source_col, l.canonical as gold_col, cast(count(*)
    as bigint) as cells_traced from cells c join lin l on l.source = c.source and l.col = c.col group by 1, 2, 3""")
def lineage_rows(spark: SparkSession, d: str) -> DataFrame:
    versions = dt.mapping_versions(spark, d)
    once = lineage.record(None, versions)
    again = lineage.record(once, versions)  # a second recording adds nothing
    edges = again.join(versions.where("status = 'confirmed'").select("mapping_version_id").distinct(),
                       "mapping_version_id").select("source", "source_col", "gold_col").distinct()
    seen = pf.value_counts(pf.cells(dt.bronze(spark, d)), ["source"]).groupBy(
        "source", F.col("column").alias("source_col")).agg(F.sum("n").alias("cells_traced"))
    return edges.join(seen, ["source", "source_col"])


@query("l02_view_dependencies", ["cells", "lin", "vw"], """select v.view_name, cast(count(*) as bigint) as cells_traced from
    cells c join lin l on l.source = c.source and l.col = c.col join vw v on v.canonical = l.canonical group by 1""")
def view_dependencies(spark: SparkSession, d: str) -> DataFrame:
    versions = dt.mapping_versions(spark, d)
    edges = lineage.record(None, versions.where("status = 'confirmed'")).select("source", "source_col", "gold_table",
                                                                              "gold_col").distinct()
    seen = pf.value_counts(pf.cells(dt.bronze(spark, d)), ["source"]).groupBy(
        "source", F.col("column").alias("source_col")).agg(F.sum("n").alias("cells_traced"))
    return (seen.join(edges, ["source", "source_col"]).join(lineage.views_of_columns(spark), ["gold_table", "gold_col"])
            .groupBy(F.col("view").alias("view_name")).agg(F.sum("cells_traced").alias("cells_traced")))


_IMPACT = """(select l.source, l.col as source_col, concat('gold.fact_delivery.', l.canonical) as gold_columns,
    coalesce(string_agg(distinct v.view_name, ',' order by v.view_name), '') as views from lin l left join vw v on
    v.canonical = l.canonical group by 1, 2, l.canonical)"""


@query("l03_impact", ["cells", "lin", "vw"], f"""select i.*, cast(n as bigint) as cells_affected from {_IMPACT} i join
    (select source, col, count(*) as n from cells group by 1, 2) c on c.source = i.source and c.col = i.source_col""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    versions = dt.mapping_versions(spark, d)
    found = lineage.impact(lineage.record(None, versions), versions)
    seen = pf.value_counts(pf.cells(dt.bronze(spark, d)), ["source"]).groupBy(
        "source", F.col("column").alias("source_col")).agg(F.sum("n").alias("cells_affected"))
    return found.join(seen, ["source", "source_col"]).select(
        "source", "source_col", F.array_join("gold_columns", ",").alias("gold_columns"),
        F.array_join("views", ",").alias("views"), "cells_affected")


@query("j14_upstream_columns", ["cells", "lin"], """select l.source, l.col as source_col, cast(count(*) as bigint) as
    cells_traced from cells c join lin l on l.source = c.source and l.col = c.col where l.canonical = 'customer_no'
    group by 1, 2""")
def upstream(spark: SparkSession, d: str) -> DataFrame:
    versions = dt.mapping_versions(spark, d)
    up = lineage.upstream(lineage.record(None, versions), versions, "customer_no").select("source", "source_col")
    seen = pf.value_counts(pf.cells(dt.bronze(spark, d)), ["source"]).groupBy(
        "source", F.col("column").alias("source_col")).agg(F.sum("n").alias("cells_traced"))
    return up.distinct().join(seen, ["source", "source_col"])


@query("f13_mapping_listing", ["bts"], f"""select b.batch_id, b.source, b.version, b.header_hash from {_VERSIONS} b order by
    b.source, b.version""")
def mapping_listing(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("order_year")  # one row per extract
    return dt.batches(spark, d).withColumn("version", F.row_number().over(order).cast("bigint")).orderBy(
        "source", "version").select("batch_id", "source", "version", "header_hash")


