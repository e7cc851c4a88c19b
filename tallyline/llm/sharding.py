"""Sharding by global prefix sums of bytes, with built-in functions only.

The rows are put in order of doc_id by a range exchange and written once with their partition's number. Sizes summed per
partition give, by a running sum over one row per partition, the bytes before each partition; a running sum inside each
partition gives the bytes before each row. The line of all bytes is then cut at equal targets: a row belongs to the
shard in which its middle byte lies, so shards are contiguous in doc_id and differ from the equal share by less than
one row at either end.

Defined results: a NULL text has no bytes, so size 1 and the checksum of the empty text; rows with a NULL doc_id come
first. Rows with the same doc_id follow one another by checksum and size; rows equal in all three are alike and any order
of them gives the same result. An empty table gives an empty table. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import materialise

ORDER = ("doc_id", "text_crc32", "size")


def shard_by_bytes(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place in the shard) of every row."""
    body = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    rows = documents.select("doc_id", (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    dealt = materialise(rows.repartitionByRange(*[F.col(c) for c in ORDER])
                        .withColumn("_part", F.spark_partition_id()), "shard_rows")
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    # one row per partition of the exchange, however many documents there are
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
                          F.sum("_bytes").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    placed = (dealt.select("*", (F.sum("size").over(inside) - F.col("size")).alias("_ahead"),
                           (F.row_number().over(inside) - 1).alias("_nth"))
              .join(F.broadcast(bases), "_part")
              .select("doc_id", "size", "text_crc32", (F.col("_rows_before") + F.col("_nth")).alias("_place"),
                      _cut(F.col("_bytes_before") + F.col("_ahead"), F.col("size"), F.col("_all"), shards).alias("shard")))
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).cast("long").alias("slot")))


def _cut(start, size, total, shards: int):
    """The shard that holds the middle of a row that starts at byte `start`; exact in decimals, so no size overflows."""
    twice = (start * 2 + size).cast("decimal(38,0)") * shards
    return F.least(F.floor(twice / (total * 2).cast("decimal(20,0)")), F.lit(shards - 1)).cast("int")
