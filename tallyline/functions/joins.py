"""Join and de-duplication helpers that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_SPREAD = 64


def lookup(df: DataFrame, dim: DataFrame, on: str, spread_by: Sequence[str]) -> DataFrame:
    """Left join `dim` (one row per key) on a string key that is often NULL.

    NULL never matches, but a plain outer join would still hash every NULL row to one task. They get one of
    NULL_SPREAD impossible keys instead. A frequent real key is left to the adaptive skew-join split, and
    whether `dim` is broadcast is decided by Spark from its size, never by a hint.
    """
    stray = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SPREAD)).cast("string"))
    right = dim.withColumnRenamed(on, "_lookup")
    return (df.withColumn("_lookup", F.coalesce(F.col(on), stray))
            .join(right, "_lookup", "left").drop("_lookup"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in `order`. An aggregate, so a frequent key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the last in `order`."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append rows whose key is not there yet; running it again changes nothing."""
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti"))


def percentile_disc_table(df: DataFrame, keys: Sequence[str], value: str,
                          points: dict[str, float]) -> DataFrame:
    """Exact discrete percentiles per group from value counts.

    Counting each distinct value first means a group's rows never meet in one task; only its distinct values
    do, as (value, count) pairs.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cumulative = counts.withColumn("_upto", F.sum("_n").over(running))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    joined = cumulative.join(totals, list(keys))
    return joined.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_total") * F.lit(p)), F.col(value))).alias(name)
        for name, p in points.items()])
