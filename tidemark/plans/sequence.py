"""Numbering rows in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def numbered(df: DataFrame, order: list[Column], name: str = "_seq", columns: list[Column] | None = None) -> DataFrame:
    """df's rows (or some columns of them) with their numbers 1, 2, 3, … in an order.

    A range sort, kept in the shared folder, numbers the rows of each partition; of every partition one count goes to
    the driver and comes back as the number of rows before it.
    """
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    kept = materialise(df.orderBy(*order).select(*(columns or ["*"]), F.spark_partition_id().alias("_part"), inside.alias("_in")))
    sizes = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    # one row a partition
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before long"))
    return kept.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_before", "_in")
