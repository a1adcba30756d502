"""Global positions of rows in an order, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits that monotonically_increasing_id keeps for the row within its partition.
ROW_BITS = 33


def bases(sizes: DataFrame, part: str = "part", size: str = "size") -> DataFrame:
    """``(part, base)``: what all smaller parts hold together; one row for each output partition comes in."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("base"))


def dealt(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``; equal rows, however many, are spread by their input position."""
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    return salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
