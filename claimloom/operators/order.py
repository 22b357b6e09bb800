"""Row numbers over groups of any size, without a task per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.plans.scratch import materialize


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with a suffix that no column of df has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_numbers(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`, 1, 2, ... within each group (or over all rows, without groups) by order.

    Rows are dealt into ranges of (groups, order) and written once with their range, numbered in
    each range, and moved up by the counts of the ranges before. So a group with a third of all
    rows is numbered by as many tasks as it fills ranges. Null groups are a group; rows that are
    equal in order are numbered in some order. An empty table gives an empty result.
    """
    if not groups:
        return _numbered(df, order, name)
    span, n, before_, place = (fresh(df, x) for x in ("span", "n", "before", "place"))
    ranged = materialize(df.repartitionByRange(*groups, *order).withColumn(span, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(span, *groups).agg(F.count("*").alias(n))
    before = Window.partitionBy(*groups).orderBy(span)
    offsets = counts.select(span, *groups, (F.sum(n).over(before) - F.col(n)).alias(before_))
    placed = ranged.withColumn(place, F.row_number().over(Window.partitionBy(span, *groups).orderBy(*order)))
    right = offsets.withColumnsRenamed({c: f"of {c}" for c in (span, *groups)})
    same: Column = reduce(lambda a, b: a & b, [placed[c].eqNullSafe(right[f"of {c}"]) for c in groups], placed[span] == right[f"of {span}"])
    return placed.join(right, same).select(*[placed[c] for c in df.columns], (right[before_] + placed[place]).alias(name))


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """row_numbers over all rows: each range is written in order with the place of its rows, so that reading adds the ranges before, a row each, and shuffles nothing."""
    mark, span, n, before_ = (fresh(df, x) for x in ("mark", "span", "n", "before"))
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()), "ranges")
    of = F.shiftright(mark, 33)  # monotonically_increasing_id: the partition above 33 bits of place
    counts = ranged.groupBy(of.alias(span)).agg(F.count("*").alias(n))
    offsets = counts.select(span, (F.sum(n).over(Window.orderBy(span)) - F.col(n)).alias(before_))
    placed = ranged.join(F.broadcast(offsets), of == F.col(span))
    return placed.select(*df.columns, (F.col(before_) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
