"""A keyed table kept as segments: what a micro-batch brings is appended, never the whole table rewritten.

Every append writes one segment with the rows it was given and a manifest that lists the live segments. Readers take the
newest manifest and, of rows with one key, the last in the given order, later segments winning ties. When FAN segments of a
level have come together they are folded into one of the next level, so a row is written once per level: what an append costs on
average follows the rows appended, times the logarithm of how many appends there have been, and not the size of the table.

An append counts once its manifest stands, which is written last. A segment no manifest lists is what a lost run left; segments
have names of their own, so nothing is written over and readers of an older manifest are not disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 8
_MANIFEST = "version bigint, segment string, level int, born bigint"


class Segments:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], order: Sequence[str] = (),
                 fan: int = FAN) -> None:
        self.spark, self.root, self.schema, self.keys, self.order, self.fan = spark, root, schema, list(keys), list(order), fan
        self.log = f"{root}/log"
        spark.createDataFrame([], _MANIFEST).write.mode("append").parquet(self.log)

    def live(self) -> list[tuple[str, int, int]]:
        """(segment, level, born) of the newest manifest, the oldest first: at most FAN of each level."""
        log = self.spark.read.schema(_MANIFEST).parquet(self.log)
        newest = log.agg(F.max("version").alias("v")).first()["v"]
        rows = [] if newest is None else log.where(F.col("version") == newest).collect()
        self._newest = newest
        return sorted(((r["segment"], r["level"], r["born"]) for r in rows), key=lambda s: s[2])

    def _rows(self, segments: Sequence[tuple[str, int, int]]) -> DataFrame:
        """The rows of segments with `_born`, the number of the append each came with last."""
        schema = f"{self.schema}, _born bigint"
        paths = [f"{self.root}/{s}" for s, _, _ in segments]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _folded(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        last = F.max_by(F.struct(*rest), F.struct(*self.order, "_born"))
        return rows.groupBy(*self.keys).agg(last.alias("_row")).select(*self.keys, "_row.*").select(*rows.columns)

    def read(self) -> DataFrame:
        return self._folded(self._rows(self.live())).drop("_born")

    def of_keys(self, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
        """The rows that agree with `wanted` on some of the keys, folded; the others are filtered out before the fold."""
        return self._folded(self._rows(self.live()).join(wanted.select(*on).distinct(), list(on), "left_semi")).drop("_born")

    def append(self, df: DataFrame) -> None:
        """Add rows; of rows with one key in `df` the last counts. Adding the same rows again changes nothing."""
        segments = self.live()
        version = 0 if self._newest is None else self._newest + 1
        columns = [c for c in self.spark.createDataFrame([], self.schema).columns]
        rows = self._folded(df.select(*columns).withColumn("_born", F.lit(version).cast("bigint")))
        segments.append((self._write(rows), 0, version))
        level = 0
        while sum(s[1] == level for s in segments) >= self.fan:
            old = [s for s in segments if s[1] == level]
            segments = [s for s in segments if s[1] != level] + [(self._write(self._folded(self._rows(old))), level + 1,
                                                                  max(s[2] for s in old))]
            level += 1
        self.spark.createDataFrame([(version, *s) for s in segments], _MANIFEST).coalesce(1).write.mode("append").parquet(self.log)

    def _write(self, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name
