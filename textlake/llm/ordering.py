"""Global order at any size: range partitions instead of one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.runtime import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def globally_sorted(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` in the order of ``keys`` (end them in a number of the row: equal rows share a range), with ``_part`` (range partition) and ``_at`` (row in it).

    The result is written once, so its numbers never change when a task is run again.
    """
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    low = F.lit((1 << _ROW_BITS) - 1)
    return materialize(
        spread.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn("_at", F.col("_id").bitwiseAND(low)).drop("_id")
    )


def with_position(df: DataFrame) -> DataFrame:
    """Adds ``_pos`` (0-based global position) and ``_total`` to a result of ``globally_sorted``.

    The broadcast side has one row a range partition, not one a row of data.
    """
    parts = df.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total")
    )
    return df.join(F.broadcast(offsets), "_part").withColumn("_pos", F.col("_start") + F.col("_at")).drop("_start")


def with_sum_before(df: DataFrame, value: str) -> DataFrame:
    """Adds ``_before``: the sum of ``value`` over all rows that come earlier in the global order.

    Running sums stay inside range partitions of bounded size; only the partitions' totals meet.
    """
    totals = df.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    run = df.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return run.join(F.broadcast(offsets), "_part").withColumn("_before", F.col("_start") + F.col("_run")).drop("_start", "_run")
