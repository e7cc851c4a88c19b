"""Structured Streaming: each file once, later batches win, previous shapes, and daily counts.

State lives in tables the batch jobs share, written per micro-batch and found again by whatever run comes next: after a
restart a run goes on from the newest committed state. Every handler gives the same state when it is given rows it has
already seen, so a repeated micro-batch or a lost checkpoint only costs a re-read. Keyed state is kept as segments, so a
micro-batch writes what it brings and not what is held.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.joins import keep_last
from tallyline.sources import extract_source
from tallyline.streaming.segments import Segments


def run_once(stream: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:  # noqa: ANN001
    """Process everything that is there now, in one or more micro-batches, and stop."""
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode)
     .trigger(availableNow=True).start().awaitTermination())


LOG = "identity string, source string, file_name string, path string, status string, error string, row_count bigint, attempt string"
_BRONZE = "source string, file_name string, path string, identity string, source_row bigint, record map<string,string>"


def _moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder that is still there; what was renamed before stays."""
    jvm = spark.sparkContext._jvm
    old, new = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(old) and not files.rename(old, new):
        raise OSError(f"cannot rename {source}")


def batch_log(spark: SparkSession, bronze: str) -> DataFrame:
    """One row per file ever taken in or refused: identity, where it was, status, error and number of rows."""
    return spark.read.schema(LOG).option("ignoreMissingFiles", True).parquet(f"{bronze}/_log")


def recover(spark: SparkSession, bronze: str) -> None:
    """Finish what a lost run had logged but not yet renamed. What it had not logged stays hidden and is taken in again."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{bronze}/_attempts")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hidden = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    for r in batch_log(spark, bronze).where(F.col("attempt").isin(hidden)).select("attempt").distinct().collect():
        _moved(spark, f"{bronze}/_attempts/{r['attempt']}", f"{bronze}/attempt={r['attempt']}")


def ingest_extracts(spark: SparkSession, path: str, header: Sequence[str] | None, bronze: str, checkpoint: str,
                    between: Callable[[str], None] = lambda step: None) -> None:
    """Append new files' rows to bronze, each file read by its own header (or refused if `header` names another).

    A file is known by its name and the digest of its content, so one that is in bronze already is skipped without a
    checkpoint, under another folder, or when it comes twice in one micro-batch. An unreadable file is logged as failed, with
    the reason, once for each content, and tried again whenever a stream comes by it anew. A micro-batch is one attempt: its rows go to a hidden folder, then its files' identities
    are appended to the log, which is what commits it, and then the folder is renamed into bronze. Known files are found by a
    join of the log with the micro-batch's own; neither old files nor bronze are read. `between` is called after each step.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        attempt = uuid.uuid4().hex
        batch = batch.withColumn("identity", F.concat_ws(":", "file_name", F.coalesce("digest", "error"))).persist(
            StorageLevel.DISK_ONLY)  # records of a whole run: held on disk, the heap is left to the tasks
        files = batch.groupBy("identity", "path").agg(
            F.any_value("source").alias("source"), F.any_value("file_name").alias("file_name"), F.max("error").alias("error"),
            F.count("source_row").alias("row_count"))
        once = files.groupBy("identity").agg(F.min(F.struct("path", "source", "file_name", "error", "row_count")).alias("f")).select(
            "identity", "f.*")
        once = once.withColumn("status", F.when(F.col("error").isNull(), "received").otherwise("failed"))
        known = batch_log(spark, bronze).select("identity", "status")
        fresh = once.join(known, ["identity", "status"], "left_anti").select(
            "identity", "source", "file_name", "path", "status", F.substring("error", 1, 2000).alias("error"), "row_count",
            F.lit(attempt).alias("attempt")).persist()
        hidden = f"{bronze}/_attempts/{attempt}"
        batch.where("error is null").join(fresh.select("path", "identity"), ["path", "identity"], "left_semi").select(
            "source", "file_name", "path", "identity", "source_row", "record").write.parquet(hidden)
        between("rows written")
        fresh.write.mode("append").parquet(f"{bronze}/_log")
        between("log written")
        _moved(spark, hidden, f"{bronze}/attempt={attempt}")
        fresh.unpersist()
        batch.unpersist()

    spark.createDataFrame([], f"{_BRONZE}").write.mode("append").parquet(f"{bronze}/attempt=none")
    spark.createDataFrame([], LOG).write.mode("append").parquet(f"{bronze}/_log")
    recover(spark, bronze)
    run_once(extract_source.stream(spark, path, f"{checkpoint}/files", header), handle, checkpoint)


def latest_by_key(spark: SparkSession, stream: DataFrame, keys: Sequence[str], order: Sequence[str], root: str,
                  checkpoint: str) -> DataFrame:
    """Keep the latest row per key over all micro-batches: each appends the latest of its own rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    held = Segments(spark, root, schema, keys, order)
    run_once(stream, lambda batch, i: held.append(batch), checkpoint)
    return held.read()


def shape_changes(spark: SparkSession, stream: DataFrame, fingerprint, root: str, checkpoint: str) -> DataFrame:  # noqa: ANN001
    """Fingerprints (source, arrival, digest) of each micro-batch, compared with the last one held per source.

    `fingerprint` turns a micro-batch into one row per extract, so the window below runs over extracts. A fingerprint that is
    held stays as it is; of those held only the batch's own sources are read.
    """
    held = Segments(spark, root, "source string, arrival string, digest string, previous_digest string", ["source", "arrival"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        shapes = fingerprint(batch)
        past = held.of_keys(shapes, ["source"])
        last = keep_last(past, ["source"], ["arrival"]).select("source", "arrival", "digest").withColumn("_old", F.lit(True))
        news = shapes.join(past.select("source", "arrival"), ["source", "arrival"], "left_anti")
        both = last.unionByName(news.withColumn("_old", F.lit(False)))
        order = Window.partitionBy("source").orderBy("arrival")
        held.append(both.withColumn("previous_digest", F.lag("digest").over(order)).where(~F.col("_old")).drop("_old"))

    run_once(stream, handle, checkpoint)
    return held.read()


def daily_counts(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Events per type and day, kept by the engine's own state (no watermark: late events still count). A micro-batch hands on
    the days it changed, with their new totals; the last it handed on count."""
    held = Segments(spark, root, "day string, event_type string, n bigint, total double", ["day", "event_type"])
    agg = stream.groupBy(F.window("ts", "1 day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n", "total")
    run_once(agg, lambda batch, i: held.append(batch), checkpoint, "update")
    return held.read()
