"""File sources and sinks, and the streaming forms, over extracts written from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators import ingest
from tallyline.plans.common import clean_lines
from tallyline.plans.registry import query
from tallyline.session import fresh_path
from tallyline.sources import driver_tables as dt
from tallyline.sources import extract_source, files, knowledge
from tallyline.streaming import ingest as st

_written: dict[tuple[str, str, str], str] = {}
FILE_ROWS = 1_000_000  # an extract of more rows is sent in several files


def as_files(spark: SparkSession, d: str, rows: DataFrame, name: str) -> DataFrame:
    """Bronze rows as the lines of extract files: source, file_name, header and values, file by file in line order."""
    parts = dt.batches(spark, d).select("batch_id", F.ceil(F.col("row_count") / FILE_ROWS).alias("_parts"))
    part = F.pmod(F.xxhash64("source_row"), F.col("_parts")) + 1
    lines = rows.join(parts, "batch_id").select(
        "source", F.format_string(f"%s_orderlines_%s-%02d{name}.csv", "source", "order_year", part).alias("file_name"),
        F.map_keys("record").alias("header"), F.map_values("record").alias("values"), "source_row")
    return lines.repartition("source", "file_name").sortWithinPartitions("source", "file_name", "source_row").drop("source_row")


def _root(spark: SparkSession, d: str, name: str, rows: Callable[[], DataFrame]) -> str:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _written:
        root = fresh_path(spark, name)
        extract_source.write(rows(), root)
        _written[key] = root
    return _written[key]


def extract_root(spark: SparkSession, d: str) -> str:
    """The raw extracts as one folder per source, each file with its own header; written once per session."""
    return _root(spark, d, "extracts", lambda: as_files(spark, d, dt.bronze(spark, d), ""))


def resent_root(spark: SparkSession, d: str) -> str:
    """What plt03 sent again under the same names, with the columns in another order."""
    return _root(spark, d, "resent", lambda: as_files(spark, d, dt.bronze(spark, d).where("source = 'plt03'"), "").withColumns(
        {"header": F.reverse("header"), "values": F.reverse("values")}))


def unreadable_root(spark: SparkSession, d: str) -> str:
    """The blocked batches as a host computer sends them: in EBCDIC."""
    lost = dt.batches(spark, d).where("status = 'blocked'").select("batch_id")
    return _root(spark, d, "unreadable", lambda: as_files(spark, d, dt.bronze(spark, d).join(
        lost, "batch_id", "left_semi"), "-host").withColumn("encoding", F.lit("cp500")))


def bronze_from_files(spark: SparkSession, d: str) -> DataFrame:
    return files.read_extracts(spark, extract_root(spark, d)).withColumn("batch_id", F.concat_ws(
        ":", "source", files.extract_of(F.col("file_name"))))


@query("s01_discover_sources", ["bts"], """select source, cast(count(*) as bigint) as extracts, cast(count(*) filter (where source =
    'plt03') as bigint) as from_first_root from bts group by 1""")
def discover(spark: SparkSession, d: str) -> DataFrame:
    """Extracts below three roots; the first holds one source again, under names the second has too."""
    first = resent_root(spark, d)
    found = files.discover(spark, [first, extract_root(spark, d), f"{first}-not-there"])
    return found.groupBy("source").agg(F.count_distinct("extract").alias("extracts"), F.count_distinct(
        F.when(F.contains("path", F.lit(first)), F.col("extract"))).alias("from_first_root"))


@query("s02_read_all_text", ["cells"], """select source, col as column_name, cast(count(*) as bigint) as cells, cast(count(*)
    filter (where value = '') as bigint) as blanks, cast(sum(length(value)) as bigint) as characters from cells group by 1, 2""")
def read_all_text(spark: SparkSession, d: str) -> DataFrame:
    cells = bronze_from_files(spark, d).select("batch_id", F.explode("record").alias("column_name", "value"))
    return cells.groupBy(F.split("batch_id", ":")[0].alias("source"), "column_name").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(F.col("value") == "").alias("blanks"),
        F.sum(F.length("value")).alias("characters"))


@query("s03_bronze_rows", ["raw"], """select batch_id, cast(count(*) as bigint) as rows, true as gapless from raw group by 1""")
def bronze_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows per batch, and whether positions run 1..n without a gap in every file."""
    per_file = bronze_from_files(spark, d).groupBy("batch_id", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("source_row").alias("lo"), F.max("source_row").alias("hi"),
        F.sum("source_row").alias("s"))
    ok = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("s") * 2 == F.col("n") * (F.col("n") + 1))
    return per_file.groupBy("batch_id").agg(F.sum("n").alias("rows"), F.every(ok).alias("gapless"))


@query("s04_batch_identity", ["bts"], """select 'first' as run, cast(count(*) as bigint) as batches from bts union all
    select 'replay', cast(count(*) filter (where source is null) as bigint) from bts union all
    select 'resent', cast(count(*) filter (where source = 'plt03') as bigint) from bts""")
def batch_identity(spark: SparkSession, d: str) -> DataFrame:
    """New batches of a first run, of a replay of its files, and of files sent again with other content."""
    log, out = fresh_path(spark, "identities"), None
    spark.createDataFrame([], "idempotency_key string").write.parquet(log)
    for run, root in (("first", extract_root(spark, d)), ("replay", extract_root(spark, d)), ("resent", resent_root(spark, d))):
        new = fresh_path(spark, f"new-{run}")
        files.new_batches(spark.read.parquet(log), files.with_identity(spark, root)).write.parquet(new)
        found = spark.read.parquet(new)
        found.select("idempotency_key").write.mode("append").parquet(log)
        part = found.agg(F.count_distinct("source", "extract").alias("batches")).withColumn("run", F.lit(run))
        out = part if out is None else out.unionByName(part)
    return out


@query("s05_stale_flag", ["bts"], """select batch_id, cast(date '1998-01-06' - cast(received_at as date) as bigint) * 24 > 72 as
    stale from bts""")
def stale_flag(spark: SparkSession, d: str) -> DataFrame:
    return dt.batches(spark, d).select("batch_id", files.stale(
        F.col("received_at").cast("timestamp"), F.lit("1998-01-06").cast("timestamp")).alias("stale"))


@query("s06_failed_batches", ["bts"], """select source, order_year as extract, 'received' as status, row_count, true as told from bts
    union all select source, order_year, 'failed', cast(0 as bigint), true from bts where status = 'blocked'""")
def failed(spark: SparkSession, d: str) -> DataFrame:
    """The batch log over readable and unreadable files; a failed one says which file and why."""
    log = files.batch_log(spark, [extract_root(spark, d), unreadable_root(spark, d)])
    named = F.startswith("error", F.concat(F.lit("cannot read "), "source", F.lit("/"), "file_name", F.lit(": ")))
    told = F.when(F.col("status") == "failed", named & F.contains("error", F.lit("utf-8"))).otherwise(F.col("error").isNull())
    return log.groupBy("source", files.extract_of(F.regexp_replace("file_name", "-host", "")).alias("extract"), "status").agg(
        F.sum("row_count").alias("row_count"), F.every(told).alias("told"))


@query("s07_master_scans", ["its", "custs"], """select uom as grp, catch_weight_flag, cast(count(*) as bigint) as n, round(sum(
    avg_lb_per_case), 3) as lb from its group by 1, 2 union all select 'customers', null, cast(count(*) as bigint), null from
    custs""")
def master_scans(spark: SparkSession, d: str) -> DataFrame:
    root = fresh_path(spark, "masters")
    dt.items(spark, d).withColumn("uom", F.lower("uom")).write.option("header", True).csv(f"{root}/items")
    dt.customers(spark, d).write.option("header", True).csv(f"{root}/customers")
    items = files.read_items(spark, f"{root}/items").groupBy(F.col("uom").alias("grp"), "catch_weight_flag").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("avg_lb_per_case"), 3).alias("lb"))
    customers = files.read_customers(spark, f"{root}/customers").agg(F.count(F.lit(1)).alias("n"))
    return items.unionByName(customers.select(F.lit("customers").alias("grp"), F.lit(None).cast("boolean").alias(
        "catch_weight_flag"), "n", F.lit(None).cast("double").alias("lb")))


@query("s08_silver_write", ["ol"], """select batch_id, cast(count(*) as bigint) as rows, cast(sum(case when batch_id =
    'plt02:1997' then line_no + 100 else line_no end) as bigint) as lines from ol group by 1""")
def silver_write(spark: SparkSession, d: str) -> DataFrame:
    """Every batch once, then one batch again with other values: only that one changes."""
    path = fresh_path(spark, "silver")
    lines = dt.order_lines(spark, d).select("batch_id", "source_row", "order_no", "line_no", "issue_date")
    files.replace_batches(lines, path)
    files.replace_batches(lines.where("batch_id = 'plt02:1997'").withColumn("line_no", F.col("line_no") + 100), path)
    return spark.read.parquet(path).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("line_no").alias("lines"))


@query("s10_sinks", ["fact"], """select fmt, plant, cast(count(*) as bigint) as rows, round(sum(ordered_weight_lb), 4) as weight
    from fact cross join (select unnest(['csv', 'parquet']) as fmt) f group by 1, 2""")
def sinks(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "sinks")
    out = clean_lines(spark, d).select("order_no", "line_no", "plant", "ordered_weight_lb", F.date_format(
        "issue_date", "yyyy").alias("year"))
    out.write.partitionBy("year").parquet(f"{path}/parquet")
    out.write.option("header", True).csv(f"{path}/csv")
    back = spark.read.parquet(f"{path}/parquet").select(F.lit("parquet").alias("fmt"), "plant", "ordered_weight_lb")
    csv = files.read_text(spark, f"{path}/csv").select(F.lit("csv").alias("fmt"), "plant", F.col(
        "ordered_weight_lb").cast("double").alias("ordered_weight_lb"))
    return back.unionByName(csv).groupBy("fmt", "plant").agg(F.count(F.lit(1)).alias("rows"), F.round(
        F.sum("ordered_weight_lb"), 4).alias("weight"))


@query("s11_knowledge_scan", [], """select cast(doc_id as varchar) as doc_id, concat('Document ', doc_id) as title, case when
    doc_id % 10 = 7 then 'superseded' else 'current' end as status, case when doc_id % 7 = 6 then 'PLT-01' end as plant,
    cast(length(replace(text, chr(13) || chr(10), chr(10))) as integer) as n_chars from documents""")
def knowledge_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = dt.table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    text = F.concat(
        F.lit("---\ndoc_id: "), key, F.lit("\ntitle: Document "), key, F.lit("\nstatus: "),
        F.when(F.col("doc_id") % 10 == 7, "superseded").otherwise("current"), F.lit("\nplant: "),
        F.when(F.col("doc_id") % 7 == 6, "PLT-01").otherwise("None"), F.lit("\nchallenges: C1\n---\n"), F.col("text"))
    parsed = knowledge.documents(docs.select(F.concat(key, F.lit(".md")).alias("file_name"), text.alias("value")))
    return parsed.select("doc_id", "title", "status", "plant", F.length("body").alias("n_chars"))


@query("w04_lot_master", ["ol", "lts"], """select lot_no, item_no, plant, cast(expiry_date as varchar) as expiry_date from (select
    o.lot_no, o.item_no, o.plant, l.expiry_date, row_number() over (partition by o.lot_no order by l.expiry_date is null,
    l.expiry_date, o.item_no, o.plant) as rn from ol o left join lts l on l.lot_no = o.lot_no where o.lot_no is not null) x
    where rn = 1""")
def lot_master(spark: SparkSession, d: str) -> DataFrame:
    known = dt.lots(spark, d).select("lot_no", "production_date", "expiry_date")
    seen = dt.order_lines(spark, d).where("lot_no is not null").join(known, "lot_no", "left").select(
        "lot_no", "item_no", "plant", "production_date", "expiry_date")
    return files.lot_master(seen).select("lot_no", "item_no", "plant", F.col("expiry_date").cast("string").alias(
        "expiry_date"))


@query("e09_idempotent_replay", ["bts", "raw"], """select 'batches' as what, n as before_n, n as after_n from (select cast(count(*)
    as bigint) as n from bts) b union all select 'bronze', n, n from (select cast(count(*) as bigint) as n from raw) r""")
def idempotent_replay(spark: SparkSession, d: str) -> DataFrame:
    """The same extracts three times over: a run killed between its rows and its log, one that goes on from there, and one that
    has lost its checkpoint. The counts are those of the tables after the second and after the third."""
    root, bronze, checkpoint = extract_root(spark, d), fresh_path(spark, "replayed"), fresh_path(spark, "cp-replayed")

    def killed(step: str) -> None:
        if step == "rows written":
            raise RuntimeError("killed here on purpose")

    try:
        st.ingest_extracts(spark, root, None, bronze, checkpoint, killed)
    except StreamingQueryException:
        pass  # the run that was killed
    counts = []
    for place in (checkpoint, fresh_path(spark, "cp-lost")):
        st.ingest_extracts(spark, root, None, bronze, place)
        log = st.batch_log(spark, bronze)
        counts.append({"batches": log.where("status = 'received'").select("source", files.extract_of(F.col(
            "file_name"))).distinct().count(), "bronze": spark.read.parquet(bronze).count()})
    return spark.createDataFrame([(what, counts[0][what], counts[1][what]) for what in ("batches", "bronze")],
                                 "what string, before_n bigint, after_n bigint")


# ---- streams -------------------------------------------------------------------------------------------------

def events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = dt.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _rows_per_batch(spark: SparkSession, bronze: str) -> DataFrame:
    return spark.read.parquet(bronze).groupBy(F.concat_ws(":", "source", files.extract_of(F.col("file_name"))).alias(
        "batch_id")).agg(F.count(F.lit(1)).alias("rows"))


@query("x01_each_file_once", ["raw"], "select batch_id, cast(count(*) as bigint) as rows from raw group by 1")
def each_file_once(spark: SparkSession, d: str) -> DataFrame:
    """All sources' extracts, whatever their headers, as one stream into one bronze, twice, the second time with a lost
    checkpoint."""
    bronze = fresh_path(spark, "stream-bronze")
    for run in ("first", "checkpoint-lost"):
        st.ingest_extracts(spark, extract_root(spark, d), None, bronze, fresh_path(spark, f"cp-{run}"))
    return _rows_per_batch(spark, bronze)


@query("x07_all_files_once", ["raw"], "select batch_id, cast(count(*) as bigint) as rows from raw group by 1")
def all_files_once(spark: SparkSession, d: str) -> DataFrame:
    """A stream that is refused every file of another header than plt03's, and then goes on without that condition."""
    bronze, checkpoint = fresh_path(spark, "stream-bronze"), fresh_path(spark, "cp-header")
    header = dt.header_of("plt03", "1996")
    st.ingest_extracts(spark, extract_root(spark, d), header, bronze, checkpoint)
    st.ingest_extracts(spark, extract_root(spark, d), None, bronze, fresh_path(spark, "cp-any"))
    return _rows_per_batch(spark, bronze)


@query("x02_late_is_flagged", [], """select event_type, cast(count(*) as bigint) as accepted, cast(count(*) filter (where epoch(
    timestamp '2024-01-20 00:00:00') - floor(epoch(ts)) > 72 * 3600) as bigint) as stale from events group by 1""")
def late_is_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Late rows stay in the stream and carry a flag; there is no watermark to drop them."""
    flagged = events_stream(spark, d).select("event_id", "event_type", files.stale(
        F.col("ts").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")).alias("stale"))
    out = fresh_path(spark, "flagged")
    st.run_once(flagged, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b={i}"), fresh_path(spark, "cp-flag"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("accepted"),
                                                             F.count_if("stale").alias("stale"))


@query("x03_later_batch_wins", [], """select user_id, event_id, event_type from (select *, row_number() over (partition by user_id
    order by ts desc, event_id desc) as rn from events) x where rn = 1""")
def later_wins(spark: SparkSession, d: str) -> DataFrame:
    s = events_stream(spark, d).select("user_id", "event_id", "event_type", "ts")
    return st.latest_by_key(spark, s, ["user_id"], ["ts", "event_id"], fresh_path(spark, "latest"), fresh_path(
        spark, "cp-latest")).select("user_id", "event_id", "event_type")


_SHAPE = "case when max(value) > 80 then 'wide' else 'narrow' end"


@query("x04_previous_shape", [], f"""select source, arrival, digest, lag(digest) over (partition by source order by arrival) as
    previous_digest from (select event_type as source, cast(cast(ts as date) as varchar) as arrival, {_SHAPE} as digest from
    events group by 1, 2) x""")
def previous_shape(spark: SparkSession, d: str) -> DataFrame:
    def shape(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.col("event_type").alias("source"), F.col("ts").cast("date").cast("string").alias(
            "arrival")).agg(F.expr(_SHAPE).alias("digest"))

    return st.shape_changes(spark, events_stream(spark, d), shape, fresh_path(spark, "shapes"), fresh_path(spark, "cp-shapes"))


@query("x05_resumed_from_bronze", ["raw"], """select batch_id, cast(count(*) as bigint) as silver_rows, cast(count(*) filter (where
    r_issue_date like '31/31%') as bigint) as with_errors from raw where batch_id like 'plt01:199%' and order_year < '1999' or
    batch_id like 'plt02:199%' and order_year < '1998' group by 1""")
def resumed(spark: SparkSession, d: str) -> DataFrame:
    """Batches blocked at first are built from bronze once their headers are confirmed; the stream is not re-read."""
    versions = dt.mapping_versions(spark, d)
    blocked = ingest.gate(dt.batches(spark, d), versions.where("header_hash in ('plt01-b', 'plt03-a')"))
    ready = ingest.resumable(blocked, versions.where("header_hash <> 'plt02-b'")).select("batch_id")
    silver = ingest.build_silver(dt.bronze(spark, d).join(ready, "batch_id", "left_semi"), versions)
    return silver.groupBy("batch_id").agg(F.count(F.lit(1)).alias("silver_rows"),
                                          F.count_if(F.size("parse_errors") > 0).alias("with_errors"))


@query("x06_daily_counts", [], """select cast(cast(ts as date) as varchar) as day, event_type, cast(count(*) as bigint) as n,
    round(sum(value), 4) as total from events group by 1, 2""")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    s = events_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return st.daily_counts(spark, s, fresh_path(spark, "daily"), fresh_path(spark, "cp-daily")).withColumn(
        "total", F.round("total", 4))
