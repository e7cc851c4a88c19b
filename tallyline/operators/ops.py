"""Operating views over the logs the jobs write, and the alerts derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.joins import percentile_disc_table

OLD_DAYS = 3


def pipeline_health(batches: DataFrame) -> DataFrame:
    state = lambda s: F.count_if(F.col("status") == s).alias(s)
    return batches.groupBy("source").agg(
        F.count(F.lit(1)).alias("batches"), *[state(s) for s in ("validated", "published", "blocked", "failed")],
        F.count_if("stale").alias("stale"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_received"),
        F.max("received_at").alias("last_received_at"))


def backlog(queue: DataFrame, now: Column) -> DataFrame:
    """What is open, whose it is, and how many days old the oldest is, to a tenth."""
    g = queue.where("status <> 'resolved'").groupBy(
        "source", "rule_id", "severity", "status", F.coalesce("owner", F.lit("(unassigned)")).alias("owner"))
    return g.agg(F.count(F.lit(1)).alias("exceptions"), F.min("created_on").alias("oldest_created")).withColumn(
        "oldest_age_days", F.round((F.unix_timestamp(now) - F.unix_timestamp(F.col("oldest_created").cast("timestamp"))) / 86400.0, 1))


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, outcomes, tokens, cost and discrete latency percentiles. Percentiles come from value counts."""
    outcome = lambda o: F.count_if(F.col("outcome") == o)
    sums = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"), outcome("ok").alias("ok"), outcome("invalid_output").alias("invalid_output"),
        outcome("error").alias("errors"), F.count_if((F.col("outcome") == "error") & F.col("error").startswith("429"))
        .alias("rate_limited"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)), 4).cast("double").alias("cost_usd"))
    tiles = percentile_disc_table(calls, keys, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    return sums.join(tiles, keys, "left")


def tool_usage(calls: DataFrame) -> DataFrame:
    sums = calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("outcome") == "empty").alias("empty"),
        F.count_if(F.col("outcome") == "error").alias("errors"), F.max("called_at").alias("last_called_at"))
    return sums.join(percentile_disc_table(calls, ["tool"], "latency_ms",
                                           {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}), "tool", "left")


def agent_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status", "outcome", "gate_disposition", "decision").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("fallback").alias("fallbacks"),
        F.round(F.avg("iterations"), 2).alias("mean_tool_calls"),
        F.min(F.when(F.col("status") == "awaiting_approval", F.col("started_at"))).alias("oldest_awaiting_since"))


def knowledge_documents(chunks: DataFrame) -> DataFrame:
    """One row per document with its number of chunks, and one without a document that counts the prior resolutions."""
    about = ["doc_type", "status", "access_level", "plant"]
    per = chunks.where("doc_type <> 'prior_resolution'").groupBy("doc_id").agg(
        *[F.min(c).alias(c) for c in about], F.count(F.lit(1)).alias("chunks"))
    prior = chunks.where("doc_type = 'prior_resolution'").agg(F.count(F.lit(1)).alias("chunks"))
    return per.unionByName(prior.withColumn("doc_type", F.lit("prior_resolution")), allowMissingColumns=True)


def alerts(health: DataFrame, open_: DataFrame, used: DataFrame, runs: DataFrame, latest_run: DataFrame) -> DataFrame:
    """Conditions to act on, one row each."""
    out = []
    for column, text in (("failed", " failed batch(es) — re-run ingest"),
                         ("blocked", " batch(es) blocked on an unconfirmed mapping"),
                         ("stale", " stale extract(s); publish refuses them")):
        out.append(health.where(F.col(column) > 0).select(F.concat(
            F.col("source"), F.lit(": "), F.col(column).cast("string"), F.lit(text)).alias("alert")))

    def total(df: DataFrame, column: str, text: str) -> DataFrame:
        return df.agg(F.sum(column).alias("_n")).where("_n > 0").select(F.concat(
            F.col("_n").cast("string"), F.lit(text)).alias("alert"))

    out.append(total(open_.where((F.col("severity") == "block") & (F.col("oldest_age_days") > OLD_DAYS)), "exceptions",
                     " blocking exception(s) older than 3 days"))
    out.append(total(used, "rate_limited", " model call(s) rate limited in the window"))
    out.append(total(runs.where("status = 'awaiting_approval'"), "runs", " agent run(s) awaiting an owner's decision"))
    out.append(latest_run.where("status = 'red'").select(F.lit(
        "latest reconciliation is red: consumer views disagree").alias("alert")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
