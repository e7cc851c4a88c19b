"""A stored index that is kept up by what changed: upserts and deletes by hash part, and versions that readers can hold on to.

Rows lie in PARTS parts by a hash of their key. A version is a manifest: for every part the folder its rows are in, how many they
are and a digest of them. A sync digests the new rows by part, and only parts whose digest differs are compared by key and
written anew, to folders of their own; the manifest of the new version names the old folders for all others. It is written last
and in one piece. A reader takes a version's manifest and is not disturbed by later syncs; a run that is lost leaves folders no
manifest names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64
_MANIFEST = "version bigint, part int, folder string, n bigint, digest string"


@dataclass(frozen=True)
class Synced:
    version: int
    inserted: int
    updated: int
    deleted: int
    parts: int  # parts written


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.schema, self.key, self.parts = spark, root, schema, key, parts
        self.log = f"{root}/manifests"
        spark.createDataFrame([], _MANIFEST).write.mode("append").parquet(self.log)

    def newest(self) -> int:
        """The newest version; 0 is the empty index."""
        return self.spark.read.schema(_MANIFEST).parquet(self.log).agg(F.max("version")).first()[0] or 0

    def manifest(self, version: int | None = None) -> dict[int, tuple[str, int, str]]:
        """part -> (folder, rows, digest); at most PARTS entries."""
        version = self.newest() if version is None else version
        rows = self.spark.read.schema(_MANIFEST).parquet(self.log).where(F.col("version") == version).collect()
        return {r["part"]: (r["folder"], r["n"], r["digest"]) for r in rows if r["part"] >= 0}

    def read(self, version: int | None = None, parts: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its parts."""
        paths = [f"{self.root}/{folder}/_part={part}" for part, (folder, _, _) in self.manifest(version).items()
                 if parts is None or part in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _parted(self, rows: DataFrame) -> DataFrame:
        columns = self.spark.createDataFrame([], self.schema).columns
        return rows.select(*columns, F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int").alias("_part"),
                           F.xxhash64(*columns).alias("_h"), F.xxhash64(F.lit(7), *columns).alias("_g"))

    def sync(self, rows: DataFrame) -> Synced:
        """Make the index equal to `rows`, which have each key once."""
        version, held = self.newest(), self.manifest()
        new = self._parted(rows)
        sums = new.groupBy("_part").agg(
            F.count(F.lit(1)).alias("n"), F.concat_ws(":", F.sum(F.col("_h").cast("decimal(38,0)")), F.bit_xor("_g")).alias("digest")).collect()
        now = {r["_part"]: (r["n"], r["digest"]) for r in sums}
        touched = sorted(p for p in held.keys() | now.keys() if now.get(p) != (held[p][1:] if p in held else None))
        if not touched:
            return Synced(version, 0, 0, 0, 0)
        new = new.where(F.col("_part").isin(touched))
        old = self._parted(self.read(version, touched)).select(self.key, F.struct("_h", "_g").alias("_old"))
        both = new.select(self.key, F.struct("_h", "_g").alias("_new")).join(old, self.key, "full")
        count = lambda c: F.count_if(c)
        n = both.agg(count(F.col("_old").isNull()), count(F.col("_old").isNotNull() & F.col("_new").isNotNull() & (
            F.col("_old") != F.col("_new"))), count(F.col("_new").isNull())).first()
        folder = f"rows-{uuid.uuid4().hex}"
        new.drop("_h", "_g").repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        entries = {p: e for p, e in held.items() if p not in touched} | {p: (folder, *now[p]) for p in touched if p in now}
        version += 1
        listed = [(version, p, *e) for p, e in entries.items()] or [(version, -1, "", 0, "")]  # an emptied index
        self.spark.createDataFrame(listed, _MANIFEST).coalesce(1).write.mode("append").parquet(self.log)
        return Synced(version, *n, len(touched))
