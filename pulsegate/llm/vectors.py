"""What the vector operators share: sound vectors, their width, and blocks of them as binary matrices.

A block is one row that holds up to `BLOCK_BYTES` of vectors, so that a pass over the data reads large
binaries instead of array elements. Blocks are written to the shared folder; tasks that are lost read them
again.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2_000_000
# Blocks that a Python worker is handed at once.
BLOCKS_AT_ONCE = 8
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Entries beyond this count as not finite: exact sums of their integers would not fit 64 bits.
LARGEST = float(1 << 20)


def doubles(column: Column) -> Column:
    return column.cast("array<double>")


def sound(column: Column, largest: float | None = None) -> Column:
    """Whether a vector is there and all its entries are there and finite (and at most `largest` in magnitude)."""
    limit = F.lit(largest if largest is not None else float(np.finfo(np.float64).max))
    entry = lambda c: c.isNotNull() & (F.abs(c) <= limit)  # noqa: E731  NaN is larger than any number
    return column.isNotNull() & F.forall(column, lambda c: F.coalesce(entry(c), F.lit(False)))


def usual_width(vectors: DataFrame, column: str) -> int | None:
    """The length that most vectors have, the larger one of equally frequent ones; None without vectors."""
    sizes = vectors.groupBy(F.size(column).alias("width")).count().orderBy(F.desc("count"), F.desc("width"))
    first = sizes.head()
    return first["width"] if first else None


@contextlib.contextmanager
def few_rows(spark: SparkSession, rows: int = BLOCKS_AT_ONCE) -> Iterator[None]:
    """While a job over blocks runs, a Python worker gets so many rows at once that its memory stays bounded."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    if not values.size:
        return values.astype(np.int8)
    return values.astype(np.result_type(np.min_scalar_type(min(int(values.min()), -1)), np.min_scalar_type(int(values.max()))))


def wide(raw: bytes, kind: str, width: int) -> np.ndarray:
    """The matrix that a block holds; integers as 64-bit ones."""
    found = np.frombuffer(raw, np.dtype(kind)).reshape(-1, width)
    return found if found.dtype.kind == "f" else found.astype(np.int64)


def in_blocks(batches, width: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, np.ndarray]]:
    """Arrow batches whose last column holds the vectors, as (other columns, matrix) of bounded size."""
    most = max(1, block_bytes // (8 * max(1, width)))
    held: list[pa.RecordBatch] = []
    count = 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
        return columns[:-1], matrix(columns[-1], width)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - count)
            held.append(part)
            at, count = at + part.num_rows, count + part.num_rows
            if count == most:
                yield joined()
                held, count = [], 0
    if held:
        yield joined()


def column_sums(df: DataFrame, array: str) -> dict[int, int | float]:
    """The sum of each place of an array column, by place; one row for each place comes to the driver."""
    places = df.select(F.posexplode(array).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total"))
    return {r["at"]: r["total"] for r in places.collect()}
