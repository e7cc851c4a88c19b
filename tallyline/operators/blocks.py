"""Every row of one table with every row of another, block by block, without a copy of either side on disk.

Both sides are dealt out by hash into numbered blocks, and a block is packed into one row of compressed Arrow tables. The pairs of
blocks are a Cartesian product with one pair in each task: a task reads its two blocks and sends on what the work on them yields.
What is written is each side once, however many blocks the other has; a task's memory follows the block sizes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASKS_PER_CORE = 2  # pairs of blocks there should be at least, where the rows suffice
LEAST = 256  # rows a block is not made smaller than for that

Pack = Callable[[pa.Table], list[pa.Table]]


def number(rows: int, size: int) -> int:
    """How many blocks of `size` rows."""
    return max(1, -(-rows // size))


def spread_number(df: DataFrame, rows: int, size: int, others: int) -> int:
    """The same, with more blocks where that many against `others` would leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(number(rows, size), min(number(rows, min(size, LEAST)), number(TASKS_PER_CORE * cores, others)))


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(cell: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(cell.as_buffer()).read_all()


def packed(df: DataFrame, key: Column, blocks: int, pack: Pack, names: list[str]) -> DataFrame:
    """_block and the tables `pack` makes of the block's rows, one for each of `names`; a block without rows has no row."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            cells = [_written(t) for t in pack(rows.drop_columns(["_block"]))]
            yield pa.RecordBatch.from_arrays([rows["_block"].combine_chunks()[:1], *(pa.array([c], pa.binary()) for c in cells)],
                                             ["_block", *names])

    dealt = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).repartitionById(blocks, "_block")
    return dealt.mapInArrow(one, "_block int, " + ", ".join(f"{n} binary" for n in names))


def crossed(left: DataFrame, right: DataFrame, numbers: tuple[int, int], work: Callable[..., Iterator[pa.RecordBatch]],
            schema: str) -> DataFrame:
    """`work` on the tables of every left block with those of every right block; `numbers` of blocks on either side."""
    names = [n for n in (*left.columns, *right.columns) if n != "_block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(*(_read(batch.column(n)[i]) for n in names))

    # the product reads its right side again for each block of the left one: from these exchanges, not by packing it again
    left, right = (df.repartitionById(n, "_block").drop("_block") for df, n in zip((left, right), numbers, strict=True))
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)
