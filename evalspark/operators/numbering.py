"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the given order over all rows; ties fall either way.

    Rows are sorted by range; a row's number is its place in its partition after
    the sizes of those before it, of which one number a partition is collected.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed)  # partitions must not change between the count and the result
    part, at = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    offsets = F.lit(starts or [0]).cast("array<long>")
    return placed.withColumn(name, F.element_at(offsets, part + 1) + at).drop("_id")


def running_total(rows: DataFrame, amount: str, name: str, *order: Column | str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` up to and with each row, in the given order, which should have no ties.

    As for numbers, only the sum of each range is collected.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = {r["p"]: r["s"] for r in ranged.groupBy(F.col("_part").alias("p")).agg(F.sum(amount).alias("s")).collect()}
    before, starts = 0, []
    for p in range(max(sums, default=-1) + 1):
        starts.append(before)
        before += sums.get(p) or 0
    earlier = F.element_at(F.lit(starts or [0]), F.col("_part") + 1)
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # one range of the sort
    return ranged.withColumn(name, earlier + inside).drop("_part")
