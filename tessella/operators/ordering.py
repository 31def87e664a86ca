"""Ranks over whole tables without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.plans import broadcast_if_small, materialise



def numbered_by(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of the columns, which should have no ties.

    Rows are dealt into ranges of the order and sorted there, and written; a row's place is its place
    in its range plus the sizes of the ranges before, of which there are as many as partitions."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = materialise(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_numbered_at", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("_numbered_range", F.shiftright("_numbered_at", 33)).withColumn("_numbered_nth", F.col("_numbered_at").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["_numbered_range"], r["n"]) for r in held.groupBy("_numbered_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "_numbered_range long, _numbered_before long")
    placed = held.join(F.broadcast(offsets), "_numbered_range").withColumn(name, F.col("_numbered_before") + F.col("_numbered_nth") + 1)
    return placed.drop("_numbered_at", "_numbered_range", "_numbered_nth", "_numbered_before")


#: Groups up to which the list of their first places is broadcast.
SMALL = 100_000


def placed_within(df: DataFrame, keys: list[str], *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, within its key in the order of the columns, which should
    have no ties there: its place among all rows, by key and order, less those before its key. A key
    that holds most rows is many ranges, not one task."""
    numbered = numbered_by(df, *keys, *order, name="_placed_at")
    first = materialise(numbered.groupBy(*keys).agg(F.min("_placed_at").alias("_placed_first")), "first-places")
    found = numbered.join(broadcast_if_small(first, SMALL), keys)
    return found.withColumn(name, F.col("_placed_at") - F.col("_placed_first") + 1).drop("_placed_at", "_placed_first")
