"""Helpers that the operators share: scratch tables, free names, Arrow columns in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.order import fresh
from claimloom.plans.scratch import drop_table, release, scratch_path, shared_folder, write_table

__all__ = ["arrow_column", "bound_batches", "drop_table", "filter_bits", "fresh", "id_filter", "materialize", "release", "scratch_path", "shared_folder", "text_bytes", "write_table"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; lost executors then cost no recomputation."""
    return write_table(df, label)[0]


#: Most bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


def bound_batches() -> None:
    """Lower the session's Arrow batches to BATCH_BYTES (it stays so): texts are long, and each task holds a batch on either side."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != f"{BATCH_BYTES}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def arrow_column(fn: Callable, returns: str) -> Callable[..., Column]:
    """An Arrow UDF that Spark evaluates once, whatever filter or projection reads its result."""
    bound_batches()
    return F.arrow_udf(fn, returnType=returns).asNondeterministic()


def text_bytes(column: pa.Array, rows: int = 256) -> Iterator[list[bytes | None]]:
    """The UTF-8 bytes of a string column, a bounded number of rows at a time."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else column
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()
    pa.default_memory_pool().release_unused()


#: Least and most bits of an id filter, as powers of two: 128 KB to 16 MB. Beyond a hundred million ids it only lets more rows through.
LEAST_BITS, MOST_BITS = 20, 27


@dataclass
class IdFilter:
    """Packed bits, on for every id of a set (and, by chance, for some others), as a broadcast."""

    size: int
    packed: Broadcast

    def bit(self, ids: Column) -> Column:
        """An id's bit."""
        return F.pmod(F.xxhash64(ids.cast("bigint")), F.lit(self.size)).cast("int")

    def is_on(self, bits: pa.Array) -> np.ndarray:
        at = bits.to_numpy(zero_copy_only=False)
        return (np.frombuffer(self.packed.value, np.uint8)[at >> 3] >> (at & 7)) & 1 == 1


def filter_bits(ids: DataFrame) -> IdFilter:
    """The filter of a table's first column. It has about 16 bits for each id; they are put together in chunks of 4 KB on the executors."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (16 * ids.count()).bit_length()))
    made = IdFilter(size, None)
    bit = (made.bit(F.col(ids.columns[0])) + 1).cast("bigint")
    chunks = ids.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).toArrow()
    packed = bytearray(size // 8)
    for n, bits in zip(chunks["n"].to_pylist(), chunks["bits"].to_pylist(), strict=True):
        packed[(n - 1) * 4096 : (n - 1) * 4096 + len(bits)] = bits
    made.packed = ids.sparkSession.sparkContext.broadcast(bytes(packed[: size // 8]))
    return made


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for every id of the one column of ids, and for some others; never true for null.

    It keeps rows that a later join would drop out of that join's shuffle.
    """
    made = filter_bits(ids)
    test = arrow_column(lambda bits: pa.array(made.is_on(bits), pa.bool_()), "boolean")
    return lambda c: c.isNotNull() & test(made.bit(c))
