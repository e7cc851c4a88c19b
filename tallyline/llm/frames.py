"""Small helpers on DataFrames that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.session import fresh_path


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder, compressed well, and read it back; its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_KEYS = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str = "n") -> DataFrame:
    """The inner join of rows with a table that has each key once and says in `n` how many of the rows have it.

    Keys of more than one row in HOT_KEYS, of which there are fewer than HOT_KEYS, are broadcast, so the rows of a
    frequent key stay in the tasks they are in. Without such keys it is a plain join.
    """
    most, total = table.agg(F.max(n), F.sum(n)).first()
    if most is None or most * HOT_KEYS <= total or total <= HOT_KEYS:
        return rows.join(table, key)
    hot = F.broadcast(table.where(F.col(n) * HOT_KEYS > total))  # fewer than HOT_KEYS rows, as the shares add up to one
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col(n) * HOT_KEYS <= total), key)
    return rows.join(hot, key).unionByName(rest)
