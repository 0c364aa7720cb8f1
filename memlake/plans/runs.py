"""Runs over globally sorted rows: a range sort, one summary per block, and a rescan with carried state.

Many operators walk each key's rows in order with a small state: sessions, versions, continuous periods. A window per
key would put a hot key's rows into one task. Here the rows are range-partitioned by (key, order), so a hot key spreads
over as many partitions as it needs. Every partition is cut into blocks; a block folds its own rows to *local runs* and
writes them as one row: the block's edges as columns, its runs as an Arrow payload. The edges of all blocks (one small
row for each block) are combined in order on the driver, which gives each block the state carried into it and what the
next block begins with. A second pass over the written blocks applies both and emits the final runs. No task ever holds
a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.plans.shared import quoted, width, written

#: Rows of a block, at least; with more than MAX_BLOCKS blocks they grow, so that the driver's part stays bounded.
BLOCK_ROWS, MAX_BLOCKS = 250_000, 100_000


def pack(table: pa.Table) -> bytes:
    """An Arrow table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """For each row of a sorted table without nulls: whether it is the first or differs from the row before."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for c in columns:
        a = table.column(c)
        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        out[1:] |= pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
    return out


def ordered_blocks(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    fold: Callable[[pa.Table], tuple[dict, pa.Table]],
    edges: str,
    rows: int,
    name: str,
) -> DataFrame:
    """The written blocks of ``df``: pid, seq, the columns of ``edges`` and the packed runs.

    Rows equal in ``keys`` always share a block. ``order`` sorts within a partition and must begin with ``keys``.
    ``fold`` turns a block's sorted rows to its edges and local runs.
    """
    block_rows = max(BLOCK_ROWS, rows // MAX_BLOCKS)
    names = [x.split()[0] for x in edges.split(",")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, n, seq = TaskContext.get().partitionId(), [], 0, 0

        def block(table: pa.Table, seq: int) -> pa.RecordBatch:
            head, runs = fold(table.combine_chunks())
            data = {"pid": [pid], "seq": [seq]} | {k: [head[k]] for k in names} | {"payload": [pack(runs)]}
            return pa.RecordBatch.from_pydict(data, schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= block_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(changes(table, keys))[-1])
                if not cut:
                    held = table.to_batches()
                    continue
                yield block(table.slice(0, cut), seq)
                held, n, seq = table.slice(cut).to_batches(), table.num_rows - cut, seq + 1
        if n:
            yield block(pa.Table.from_batches(held), seq)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema(
        [("pid", pa.int32()), ("seq", pa.int32())]
        + [(x.split()[0], kinds[x.split()[1]]) for x in edges.split(",")]
        + [("payload", pa.binary())]
    )
    parts = width(df.sparkSession, rows, block_rows)
    placed = df.repartitionByRange(parts, *[df[k] for k in keys]).sortWithinPartitions(*order)
    return written(placed.mapInArrow(build, f"pid int, seq int, {edges}, payload binary"), name)


def rescanned(
    blocks: DataFrame,
    carry: Callable[[list], list],
    emit: Callable[[pa.Table, dict], pa.Table],
    schema: str,
) -> DataFrame:
    """The final rows of all blocks. ``carry`` gets the edges in order and returns what each block needs to know."""
    heads = sorted(blocks.drop("payload").collect(), key=lambda r: (r.pid, r.seq))
    known = {(r.pid, r.seq): k for r, k in zip(heads, carry(heads), strict=True)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, seq, blob in zip(b.column("pid").to_pylist(), b.column("seq").to_pylist(), b.column("payload"), strict=True):
                out = emit(unpack(blob.as_buffer()), known[pid, seq])
                yield from out.to_batches(max_chunksize=50_000)

    return blocks.select("pid", "seq", "payload").mapInArrow(scan, schema)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "__r") -> DataFrame:
    """``df`` with each row's 1-based place within its keys (null is a key too), by ``order``, as a bigint column.

    A window per key would sort a hot key in one task. Here the rows are range-partitioned by keys and order; each
    partition numbers its own rows, and what the partitions before it hold of the same keys, counted in one small
    table, is added. Without keys the whole table is numbered so. Rows equal in ``order`` may come in any order.
    """
    k = [F.col(quoted(c)) for c in keys]
    each = df.count()
    placed = df.repartitionByRange(width(df.sparkSession, each, max(BLOCK_ROWS, each // MAX_BLOCKS)), *k, *order).withColumn("__pid", F.spark_partition_id())
    placed = written(placed, "numbered")
    upto = Window.partitionBy(*k).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    held = placed.groupBy("__pid", *k).agg(F.count(F.lit(1)).alias("n"))
    before = held.select("__pid", *[c.alias(f"__k{i}") for i, c in enumerate(k)], F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))
    own = placed.withColumn("__own", F.row_number().over(Window.partitionBy("__pid", *k).orderBy(*order)))
    out = own.join(before.withColumnRenamed("__pid", "__pid2"), (own["__pid"] == F.col("__pid2")) & _same(own, keys))
    return out.select(*[F.col(quoted(c)) for c in df.columns], (F.col("__own") + F.col("__before")).cast("bigint").alias(name))


def _same(own: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(keys):
        out = out & own[quoted(c)].eqNullSafe(F.col(f"__k{i}"))
    return out
